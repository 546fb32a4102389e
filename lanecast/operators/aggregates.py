"""Whole-table aggregates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """B1: drop rows where any of ``subset`` is NULL or NaN."""
    return df.na.drop(subset=subset)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with mean, sample std, min and max (one pass, partial aggregates)."""
    stats = df.agg(*[f(c).alias(f"{n}__{c}") for c in columns
                     for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean__{c}").cast("double").alias("mean"),
                              F.col(f"std__{c}").cast("double").alias("std"),
                              F.col(f"min__{c}").cast("double").alias("min"),
                              F.col(f"max__{c}").cast("double").alias("max")) for c in columns])
    return stats.select(F.inline(rows))


def pipeline_report(features: DataFrame, train_rows: int) -> DataFrame:
    """Counts and shares printed at the end of the feature build."""
    cat = F.col("distance_category")
    return features.agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.lit(train_rows).cast("long").alias("train_rows"),
        (F.count(F.lit(1)) - F.lit(train_rows)).alias("test_rows"),
        F.avg("delay_flag").alias("delay_rate"),
        F.avg("is_peak_month").alias("peak_share"),
        F.avg((cat == 0).cast("int")).alias("short_share"),
        F.avg((cat == 1).cast("int")).alias("medium_share"),
        F.avg((cat == 2).cast("int")).alias("long_share"))


def target_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample std, min and max of one column."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
                  F.min(column).alias("min"), F.max(column).alias("max"))
