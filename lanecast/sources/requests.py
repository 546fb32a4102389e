"""Quote-request sources and the quote sink (A9, A10) plus the requests view over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanecast.constants import CITY_COORDS

#: Column with the text of an unreadable line.
CORRUPT = "_corrupt_record"

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("trip_date", T.StringType()),
    T.StructField("weight_tonnes", T.DoubleType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("competitor_price", T.DoubleType()),
    T.StructField("diesel_price", T.DoubleType()),
    T.StructField("addons", T.ArrayType(T.StringType())),
    T.StructField("origin_lat", T.DoubleType()),
    T.StructField("origin_lon", T.DoubleType()),
    T.StructField("dest_lat", T.DoubleType()),
    T.StructField("dest_lon", T.DoubleType()),
])


def request_schema(extra: str | None = None) -> T.StructType:
    """The request fields, ``extra`` ones (DDL), and the text of lines that are no JSON object of these."""
    more = T.StructType.fromDDL(extra).fields if extra else []
    return T.StructType(REQUEST_SCHEMA.fields + more + [T.StructField(CORRUPT, T.StringType())])


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines requests with the fixed schema; malformed lines keep their text in ``_corrupt_record``."""
    return (spark.read.schema(request_schema()).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def stream_requests(spark: SparkSession, path: str, extra: str | None = None, files: int | None = None) -> DataFrame:
    """A9 as a stream: the JSON-lines files that arrive in ``path``, ``files`` of them a micro-batch at most."""
    reader = (spark.readStream.schema(request_schema(extra)).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT))
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def split_corrupt(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable requests, and the lines that are not, as rejected rows with an ``error``; read persisted rows twice."""
    if CORRUPT not in requests.columns:
        return requests, requests.limit(0).withColumn("error", F.lit(None).cast("string"))
    broken = requests.where(F.col(CORRUPT).isNotNull())
    return requests.where(F.col(CORRUPT).isNull()).drop(CORRUPT), broken.withColumn("error", F.lit("Malformed request: not a JSON object of the request fields"))


def write_quotes(quotes: DataFrame, path: str, fmt: str = "json") -> None:
    """A10: emit the nested quote documents (JSON lines by default, or parquet).

    JSON lines are gzipped: a document is about 1.7 KB of mostly equal field names, and Spark reads it back as it is.
    """
    w = quotes.write.mode("overwrite")
    (w.json(path, compression="gzip") if fmt == "json" else w.parquet(path))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index, values):
    """values[index] for a small fixed list (input shaping only)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote requests shaped from orders and the customer's region (input shaping only).

    Four kinds of place names (exact lane key, lane substring, gazetteer city, unknown) and some that
    are too short or too long, weights 0-51 tonnes (0 and 51 invalid), mixed-case vehicle classes,
    optional competitor and diesel prices (some extreme, some invalid), dates with other layouts or
    missing, coordinates (some out of range), add-on lists with repeats and unknown ids.  The
    ``p_delay`` and ``eff`` columns stand in for model outputs.
    """
    return requests_from_orders(spark, sf_dir, _table(spark, sf_dir, "orders"))


def requests_from_orders(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Same shaping over any orders DataFrame (batch or streaming); dimensions are static joins."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    cr = c.join(nr, c.c_nationkey == nr.n_nationkey).select("c_custkey", "r_name")
    # a merge join deals the orders over all tasks at every size, as one file may be one task
    df = o.join(cr.hint("merge"), o.o_custkey == cr.c_custkey)

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    k4 = k % 4
    origin = (F.when(k % 83 == 0, F.lit("X")).when(k % 79 == 0, F.lit("Long" * 31))
              .when(k4 == 0, F.concat(F.lit(" "), F.col("r_name"), F.lit(" ")))
              .when(k4 == 1, F.substring("r_name", 1, 4))
              .when(k4 == 2, _pick(ck % 5, ["Delhi", "Mumbai", "Pune", "Bengaluru", "Kochi"]))
              .otherwise(F.lit("Nowhere")))
    dest = (F.when((k4 == 0) & (ck % 7 == 0), F.lit("HARBOUR"))
            .when(k4 == 0, _pick(ck % 3, ["ASIA", "EUROPE", "AFRICA"]))
            .when(k4 == 1, F.lit("EUR"))
            .when(k4 == 2, _pick(ck % 3, ["Jaipur", "Surat", "Salem"]))
            .otherwise(F.lit("Elsewhere")))
    prio = F.substring("o_orderpriority", 1, 1)
    vehicle = (F.when(k % 26 == 0, F.lit("Carting")).when(prio == "1", F.lit("lcv")).when(prio == "2", F.lit(" MCV ")).when(prio == "3", F.lit("FTL"))
               .when(prio == "5", F.lit("CARTING")).otherwise(F.lit(None).cast("string")))
    k3 = k % 3
    addons = (F.when(k3 == 1, F.array(F.lit("extra_rope"), F.lit("extra_rope"), F.lit("unknown")))
              .when(k3 == 2, F.array(F.lit("helper_required"), F.lit("express_delivery")))
              .otherwise(F.lit(None).cast("array<string>")))
    return df.select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        origin.alias("origin"), dest.alias("destination"),
        F.when(k % 89 == 0, F.lit(None)).when(k % 97 == 0, F.date_format("o_orderdate", "dd-MM-yyyy"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("trip_date"),
        (k % 52).cast("double").alias("weight_tonnes"),
        vehicle.alias("vehicle_type"),
        F.when(k % 103 == 0, F.lit(0.0)).when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 5)
         .alias("competitor_price"),
        F.when(k % 17 == 0, F.lit(250.0)).when(k % 13 == 0, F.lit(200.0))
         .when(F.col("o_orderstatus") == "P", F.lit(95.5)).alias("diesel_price"),
        addons.alias("addons"),
        F.when(k % 101 == 0, F.lit(95.0)).otherwise(_coordinates()[0]).alias("origin_lat"),
        *[x.alias(n) for x, n in zip(_coordinates()[1:], ("origin_lon", "dest_lat", "dest_lon"))],
        F.when(k % 13 == 0, F.lit(0.0)).otherwise((k % 101).cast("double") / 100).alias("p_delay"),
        F.when(k % 13 == 0, F.lit(1.0)).otherwise((ck % 101).cast("double") / 100).alias("eff"),
    )


def _coordinates() -> list:
    """Request coordinates of every fifth and every thirteenth order (input shaping only)."""
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda base, x, n: F.when((k % 5 == 1) | (k % 13 == 0), F.lit(base) + (x % n).cast("double") / 100)
    return [at(8.0, ck, 2900), at(68.0, k, 2900), at(8.0, k, 2800), at(68.0, ck, 2800)]


def road_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road distances ``(lat1, lon1, lat2, lon2, km)`` shaped from orders (input shaping only).

    Request coordinates of some orders (some pairs twice, some with 0 for unknown) and one pair of cities.
    """
    k, ck, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    xy = [F.when((k % 101 == 0) & F.lit(i == 0), F.lit(95.0)).otherwise(x).alias(n)
          for i, (x, n) in enumerate(zip(_coordinates(), ("lat1", "lon1", "lat2", "lon2")))]
    own = o.where((k % 5 == 1) & (k % 3 == 0) | (k % 13 == 0)).select(
        *xy, F.when(k % 7 == 0, F.lit(0.0)).when(k % 13 == 0, price / 20).otherwise(price / 100).alias("km"))
    zero = o.where((k % 5 == 1) & (k % 6 == 0)).select(*xy, F.lit(0.0).alias("km"))
    ends = [*CITY_COORDS["delhi"], *CITY_COORDS["jaipur"]]
    city = o.where((k % 4 == 2) & (ck % 15 == 0)).select(
        *[F.lit(v).alias(n) for v, n in zip(ends, ("lat1", "lon1", "lat2", "lon2"))],
        (F.lit(100.0) + price / 1000).alias("km"))
    return own.unionByName(zero).unionByName(city)
