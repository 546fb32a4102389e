"""Trip sources and sinks (A1-A5) and the trips view over the driver's tables.

Raw trips arrive as text files with a header row; the date columns are text until
``coerce_timestamps`` parses them (bad values become NULL, as a lenient parser would).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.functions import expr as E

DATE_COLUMNS = ["trip_start_date", "trip_end_date", "actual_eta", "Planned_ETA", "BookingIDDate"]

TRIP_COLUMNS = {
    "BookingID": "string", "vehicle_no": "string", "Origin_Location": "string", "Destination_Location": "string",
    "TRANSPORTATION_DISTANCE_IN_KM": "double", "trip_start_date": "string", "trip_end_date": "string",
    "Planned_ETA": "string", "actual_eta": "string", "BookingIDDate": "string", "Market/Regular": "string",
}
OPTIONAL_COLUMNS = ("Planned_ETA", "actual_eta", "BookingIDDate", "Market/Regular")

# Date layouts beside ISO, for the ``formats`` option (pattern letters of Spark's datetime patterns).
MONTH_FIRST = ("M/d/yyyy H:mm[:ss]", "M/d/yyyy", "M-d-yyyy H:mm[:ss]", "M-d-yyyy")
DAY_FIRST = ("d/M/yyyy H:mm[:ss]", "d/M/yyyy", "d-M-yyyy H:mm[:ss]", "d-M-yyyy")


def trim_columns(df: DataFrame) -> DataFrame:
    """A2: strip white space around header names."""
    return df.toDF(*[str(c).strip() for c in df.columns])


def scan_trips(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: read raw trips from a folder (CSV with header by default, or parquet), columns found by name.

    The columns of ``TRIP_COLUMNS`` come first, in that order and with those types; optional ones that are absent stay
    absent, a missing required one is an error, further columns follow as they are.  NaN counts as missing (NULL).
    Text that is no number gives NULL.  All CSV files must have the same header.
    """
    if fmt == "parquet":
        df = trim_columns(spark.read.parquet(path))
    else:
        df = trim_columns(spark.read.options(header=True, mode="PERMISSIVE", enforceSchema=False).csv(path))
    missing = [c for c in TRIP_COLUMNS if c not in df.columns and c not in OPTIONAL_COLUMNS]
    if missing:
        raise ValueError(f"the trips under {path} lack the columns {missing}")
    out = []
    for name, kind in TRIP_COLUMNS.items():
        if name in df.columns:
            c = F.col(f"`{name}`")
            if kind == "double":
                c = E.not_nan(c.try_cast("double"))
            elif dict(df.dtypes)[name] not in ("timestamp", "timestamp_ntz", "date"):
                c = c.cast("string")
            out.append(c.alias(name))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in TRIP_COLUMNS])


def parse_timestamp(text, formats: tuple[str, ...] = ()) -> "F.Column":
    """Text -> TIMESTAMP_NTZ (wall-clock, independent of the session time zone); bad text -> NULL.

    Accepts ISO layouts: yyyy[-[m]m[-[d]d]] optionally followed by ' ' or 'T' and a time
    [h]h:[m]m[:[s]s[.fraction]]; then the first of ``formats`` that fits (see ``MONTH_FIRST``,
    ``DAY_FIRST``).  Anything else becomes NULL.
    """
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

    def by(fmt):  # read as UTC and shown as wall-clock, so no time zone rule applies
        instant = F.try_to_timestamp(F.concat(t, F.lit(" +00:00")), F.lit(f"{fmt} xxx"))
        return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)
    return F.coalesce(t.try_cast("timestamp_ntz"), *[by(f) for f in formats])


def coerce_timestamps(df: DataFrame, columns=DATE_COLUMNS, formats: tuple[str, ...] = ()) -> DataFrame:
    """A3: parse the date columns that exist; text in no accepted layout becomes NULL.

    Columns that already hold timestamps are converted to TIMESTAMP_NTZ unchanged.
    """
    types = dict(df.dtypes)
    new = {}
    for c in columns:
        if c not in types or types[c] == "timestamp_ntz":
            continue
        if types[c] in ("timestamp", "date"):
            new[c] = F.col(c).cast("timestamp_ntz")
        else:
            new[c] = parse_timestamp(F.col(c).cast("string"), formats)
    return df.withColumns(new) if new else df


def write_features(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "parquet") -> None:
    """A4: persist the chosen columns (parquet; CSV with header as an option)."""
    out = df.select(*columns) if columns else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.parquet(path)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: read a persisted feature table back."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips in the reference's column layout, shaped from lineitem and its dimensions.

    Only input shaping: every feature is computed later by the library.  Dates are
    rendered as text, as they would be in the raw file.  One lane has no recorded distance (0) and one
    destination is rare, so that lanes of every kind occur.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    place = (nation.join(region, nation.n_regionkey == region.r_regionkey)
             .select("n_nationkey", "r_name", F.concat_ws(", ", "n_name", "r_name", F.lit("India")).alias("place")))
    o_place = F.broadcast(place.toDF("_on", "o_region", "o_place"))       # the nations: a fixed dimension
    d_place = F.broadcast(place.toDF("_dn", "d_region", "d_place"))

    # customers meet the orders before the wider line items do, and the place names come last, so that no name is
    # shuffled; the merge join deals the line items over all tasks at every size, as one file may be one task
    placed = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "o_orderpriority", "c_nationkey")
    df = (li.join(placed.hint("merge"), li.l_orderkey == placed.o_orderkey)
          .join(supp, li.l_suppkey == supp.s_suppkey)
          .join(o_place, F.col("s_nationkey") == F.col("_on"))
          .join(d_place, F.col("c_nationkey") == F.col("_dn")))

    start = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)
    end = start + F.make_dt_interval(hours=F.ceil(F.col("l_extendedprice") / 5000).cast("int"))
    late_h = (F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100) - 9).cast("int")
    actual = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), F.lit(None)) \
        .otherwise(end + F.make_dt_interval(hours=late_h))
    prio = F.substring("o_orderpriority", 1, 1)
    fmt = "yyyy-MM-dd HH:mm:ss"
    veh = F.floor(F.col("l_partkey") / 10).cast("string")
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("BookingID"),
        F.concat(F.lit("V"), F.lpad(veh, F.greatest(F.lit(6), F.length(veh)), F.lit("0"))).alias("vehicle_no"),
        F.col("o_place").alias("Origin_Location"),
        F.when(F.col("l_orderkey") % 499 == 0, F.lit("HARBOUR, HARBOUR, India")).otherwise(F.col("d_place"))
         .alias("Destination_Location"),
        F.when((F.col("o_region") == "AFRICA") & (F.col("d_region") == "EUROPE"), F.lit(0.0))
         .when((F.col("l_linenumber") == 7) & (F.col("l_quantity") <= 5), F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") / 100).alias("TRANSPORTATION_DISTANCE_IN_KM"),
        F.date_format(start, fmt).alias("trip_start_date"),
        F.date_format(end, fmt).alias("trip_end_date"),
        F.date_format(end, fmt).alias("Planned_ETA"),
        F.date_format(actual, fmt).alias("actual_eta"),
        F.when(prio.isin("1", "2"), F.lit("Regular ")).when(prio == "4", F.lit(None).cast("string"))
         .otherwise(F.lit("Market")).alias("Market/Regular"),
    )


def load_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips view with parsed timestamps (A1 + A3 over the driver's tables)."""
    return coerce_timestamps(trim_columns(trips_view(spark, sf_dir)))
