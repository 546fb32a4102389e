"""Train split and min-max scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRE_SCALE = ["lane_popularity_log", "cost_weight_raw", "idle_loss_raw", "route_risk_smoothed"]
SCALED = ["lane_popularity", "cost_weight", "idle_loss", "route_risk"]
_EPS10 = 10 * 2.220446049250313e-16     # ranges below this count as zero (divide by 1)


def add_train_mask(df: DataFrame, n_rows: int, share: float = 0.8) -> DataFrame:
    """The first floor(share * n) rows of the (vehicle, start, BookingID) sort are train rows."""
    cut = int(n_rows * share)
    return df.withColumn("is_train", F.col("sort_position") < F.lit(cut))


def time_sort_position(df: DataFrame) -> DataFrame:
    """Replace ``sort_position`` by the position in (start, vehicle, BookingID) order (NULL starts last),
    computed with the chunked scan (no single-partition sort)."""
    from lanecast.operators.scan import chunked_scan
    order = ["trip_start_date", "vehicle_no", "BookingID"]
    return chunked_scan(df.drop("sort_position"), [], order).withColumnRenamed("_pos", "sort_position")


def minmax_fit(df: DataFrame, columns: list[str], where=None) -> dict[str, tuple[float | None, float | None]]:
    """Min and max per column (NULLs skipped), on the rows selected by ``where``."""
    src = df.where(where) if where is not None else df
    row = src.agg(*[F.min(c).alias(f"min_{c}") for c in columns],
                  *[F.max(c).alias(f"max_{c}") for c in columns]).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in columns}


def scaler_params(lo: float | None, hi: float | None) -> tuple[float | None, float | None]:
    """(scale, offset) so that x * scale + offset maps [lo, hi] to [0, 1]; zero range -> scale 1."""
    if lo is None or hi is None:
        return None, None
    rng = hi - lo
    scale = 1.0 / (1.0 if rng < _EPS10 else rng)
    return scale, 0.0 - lo * scale


def minmax_apply(df: DataFrame, state: dict, columns: list[str], outputs: list[str]) -> DataFrame:
    """X * scale + offset with the fitted state; no clipping (test rows may leave [0, 1])."""
    out = df
    for c, o in zip(columns, outputs):
        scale, offset = scaler_params(*state[c])
        if scale is None:
            out = out.withColumn(o, F.lit(None).cast("double"))
        else:
            out = out.withColumn(o, F.col(c) * F.lit(scale) + F.lit(offset))
    return out


def save_scaler(spark: SparkSession, state: dict, path: str) -> None:
    """A5: persist a fitted state as a one-row parquet table (min/max per column)."""
    cols = sorted(state)
    row = {}
    for c in cols:
        row[f"min__{c}"], row[f"max__{c}"] = state[c]
    schema = ", ".join(f"`{k}` double" for k in row)
    spark.createDataFrame([tuple(row.values())], schema).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> dict:
    """A5: read a state written by ``save_scaler``."""
    r = spark.read.parquet(path).first().asDict()
    names = {k.split("__", 1)[1] for k in r}
    return {c: (r[f"min__{c}"], r[f"max__{c}"]) for c in names}


def add_dist_norm(df: DataFrame, max_dist: float | None) -> DataFrame:
    """Distance / max distance of the fit rows."""
    return df.withColumn("dist_norm", F.col("TRANSPORTATION_DISTANCE_IN_KM") / F.lit(max_dist))


def add_confidence(df: DataFrame) -> DataFrame:
    """1 - scaled route risk."""
    return df.withColumn("confidence_score", F.lit(1.0) - F.col("route_risk"))


def risk_raw(df: DataFrame) -> DataFrame:
    """I16 (first half): weighted raw risk."""
    raw = (F.lit(0.15) * F.col("delay_flag") + F.lit(0.20) * F.col("dist_norm")
           + F.lit(0.30) * (F.lit(1.0) - F.col("lane_popularity")) + F.lit(0.35) * F.col("route_risk"))
    return df.withColumn("risk_score_raw", raw)
