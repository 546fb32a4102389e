"""Request validation and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.functions import expr as E

# strict YYYY-MM-DD as a "%Y-%m-%d" parser accepts it (month and day may have one digit)
DATE_RE = r"^(\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])\z"


def parse_trip_date(c) -> Column:
    """Strict date text -> DATE; anything else (format or calendar) -> NULL."""
    s = E.col(c)
    norm = F.concat_ws("-", F.regexp_extract(s, DATE_RE, 1),
                       F.lpad(F.trim(F.regexp_extract(s, DATE_RE, 2)), 2, "0"),
                       F.lpad(F.trim(F.regexp_extract(s, DATE_RE, 3)), 2, "0"))
    return F.when(s.rlike(DATE_RE), F.try_to_date(norm, "yyyy-MM-dd"))


def _len_reasons(field: str) -> list[Column]:
    x = F.col(field)
    return [
        F.when(x.isNull(), F.lit(f"{field}: Field required")),
        F.when(F.length(x) < 2, F.lit(f"{field}: String should have at least 2 characters")),
        F.when(F.length(x) > 120, F.lit(f"{field}: String should have at most 120 characters")),
        # deviation on purpose: a name that is blank once stripped would match any lane by substring
        F.when(x.isNotNull() & (F.length(x) >= 2) & (F.length(E.strip(x)) == 0), F.lit(f"{field}: blank")),
    ]


def _range(field: str, gt=None, ge=None, le=None, required=False) -> list[Column]:
    x = F.col(field)
    out = []
    if required:
        out.append(F.when(x.isNull(), F.lit(f"{field}: Field required")))
    if gt is not None:
        out.append(F.when(x <= gt, F.lit(f"{field}: Input should be greater than {gt}")))
    if ge is not None:
        out.append(F.when(x < ge, F.lit(f"{field}: Input should be greater than or equal to {ge}")))
    if le is not None:
        out.append(F.when(x > le, F.lit(f"{field}: Input should be less than or equal to {le}")))
    return out


def validation_reasons(df: DataFrame) -> Column:
    """Array of the failed rules of one request (empty when valid)."""
    td = F.col("trip_date")
    checks = (_len_reasons("origin") + _len_reasons("destination")
              + [F.when(td.isNull(), F.lit("trip_date: Field required")),
                 F.when(td.isNotNull() & parse_trip_date(td).isNull(),
                        F.lit("trip_date: Value error, trip_date must be in YYYY-MM-DD format"))]
              + _range("weight_tonnes", gt=0, le=50, required=True)
              + _range("competitor_price", gt=0)
              + _range("diesel_price", gt=0, le=200)
              + _range("origin_lat", ge=-90, le=90) + _range("origin_lon", ge=-180, le=180)
              + _range("dest_lat", ge=-90, le=90) + _range("dest_lon", ge=-180, le=180))
    return F.array_compact(F.array(*checks))


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected); rejected rows carry the reasons joined by '; '."""
    tagged = df.withColumn("_reasons", validation_reasons(df))
    valid = tagged.where(F.size("_reasons") == 0).drop("_reasons")
    rejected = (tagged.where(F.size("_reasons") > 0)
                .withColumn("error", F.concat(F.lit("Validation error: "), F.array_join("_reasons", "; ")))
                .drop("_reasons"))
    return valid, rejected


def normalize_requests(df: DataFrame) -> DataFrame:
    """Trimmed places, known vehicle class (default FTL), diesel default, known add-ons only."""
    vt = F.col("vehicle_type")
    vt0 = F.upper(E.strip(F.when(vt.isNull() | (vt == ""), F.lit(K.DEFAULT_VEHICLE)).otherwise(vt)))
    known_vehicles = list(K.VEHICLE_CONFIG)
    dp = F.col("diesel_price")
    has_diesel = dp.isNotNull() & (dp != 0)
    known = F.array(*[F.lit(a) for a in K.ADDON_CONFIG])
    return df.withColumns({
        "origin": E.strip("origin"), "destination": E.strip("destination"),
        "vehicle_type": F.when(vt0.isin(*known_vehicles), vt0).otherwise(F.lit(K.DEFAULT_VEHICLE)),
        "diesel_source": F.when(has_diesel, F.lit("vision")).otherwise(F.lit("default")),
        "diesel_price": F.when(has_diesel, dp).otherwise(F.lit(K.DEFAULT_DIESEL)),
        "addons": filter_known(F.coalesce(F.col("addons"), F.array().cast("array<string>")), known)})


def filter_known(arr: Column, known: Column) -> Column:
    """Keep the elements found in ``known`` (order and repeats kept)."""
    return F.filter(arr, lambda x: F.array_contains(known, x))


def clamp_weight(df: DataFrame) -> DataFrame:
    """B6 (opt-in UI rule): weight above the class maximum -> the class default."""
    vt = F.col("vehicle_type")
    mx = F.create_map(*[x for k, (m, _) in K.WEIGHT_LIMITS.items() for x in (F.lit(k), F.lit(m))])
    df_ = F.create_map(*[x for k, (_, dft) in K.WEIGHT_LIMITS.items() for x in (F.lit(k), F.lit(dft))])
    w = F.col("weight_tonnes")
    return df.withColumn("weight_tonnes", F.when(mx[vt].isNotNull() & (w > mx[vt]), df_[vt]).otherwise(w))
