"""Efficiency scores, labels and stacked targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.functions import expr as E
from lanecast.operators.scan import exact_quantiles


@dataclass(frozen=True)
class ScoreWeights:
    ops: float
    popularity: float
    cost: float
    risk: float
    driver: float
    peak_bonus: float
    maturity_cap: float | None      # None: no maturity bonus
    maturity_rate: float = 0.005


def _c(name: str) -> Column:
    return F.col(name)


def efficiency_expr(w: ScoreWeights) -> Column:
    """Rule-based efficiency score, clipped to [0, 1] and rounded half-even to 4 digits."""
    pop, cost, risk = _c("lane_popularity"), _c("cost_weight"), _c("risk_score")
    fallback = F.lit(0.30) + F.lit(0.30) * pop + F.lit(0.20) * cost + F.lit(0.20) * (F.lit(1.0) - risk)

    km = _c("TRANSPORTATION_DISTANCE_IN_KM")
    adj_lambda = F.lit(K.LAMBDA_BASE) / F.greatest(F.lit(1.0), F.log1p(km / 100))
    t_adj = F.greatest(F.lit(0.0), _c("dwell_time_hrs") - F.lit(K.GRACE_PERIOD))
    ops = F.exp(-adj_lambda * t_adj) * (F.lit(0.7) + F.lit(0.3) * _c("dist_norm"))
    ops = (F.when(_c("is_return_trip") == 1, F.least(F.lit(1.0), ops * F.lit(1.5)))
           .when(_c("is_deadhead") == 1, ops * F.lit(0.35)).otherwise(ops))
    score = (ops * F.lit(w.ops) + pop * F.lit(w.popularity) + cost * F.lit(w.cost)
             + (F.lit(1.0) - risk) * F.lit(w.risk) + (F.lit(1.0) - _c("driver_delay_rate")) * F.lit(w.driver))
    if w.maturity_cap is not None:
        score = score + F.least(F.lit(w.maturity_cap), _c("lane_maturity") * F.lit(w.maturity_rate))
    score = F.when(_c("is_peak_month") == 1, score + F.lit(w.peak_bonus)).otherwise(score)

    use_fallback = _c("next_start_time").isNull() | ~_c("is_continuous")
    chosen = F.when(use_fallback, fallback).otherwise(score)
    return E.round_even(E.clip(chosen, 0.0, 1.0), 4)


def tercile_edges(df: DataFrame, column: str = "efficiency_score") -> list[float]:
    """The 0, 1/3, 2/3 and 1 quantiles; equal edges are an error (as a quantile cut raises)."""
    edges = exact_quantiles(df, column, [0.0, 1.0 / 3.0, 2.0 / 3.0, 1.0])
    if any(e is None for e in edges):
        raise ValueError(f"no values in {column} to cut into terciles")
    if len(set(edges)) < len(edges):
        raise ValueError(f"Bin edges must be unique: {edges!r}")
    return edges


def label_expr(column: str, edges: list[float]) -> Column:
    """Right-closed value cut-offs Low <= e1 < Medium <= e2 < High; NULL stays NULL."""
    x = _c(column)
    low, mid, high = K.EFFICIENCY_LABELS
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(x <= F.lit(edges[1]), F.lit(low))
            .when(x <= F.lit(edges[2]), F.lit(mid)).otherwise(F.lit(high)))


def elite_target_81(df: DataFrame, p_col: str = K.DELAY_PROB_COL, out: str = "probabilistic_efficiency") -> DataFrame:
    """Stacked target; missing columns default to maturity 0, no peak, category 1."""
    cols = set(df.columns)
    maturity = _c("lane_maturity") if "lane_maturity" in cols else F.lit(0.0)
    peak = _c("is_peak_month") if "is_peak_month" in cols else F.lit(0)
    cat = _c("distance_category") if "distance_category" in cols else F.lit(1)
    score = (F.lit(0.35) * _c("efficiency_score") + F.lit(0.20) * _c("lane_popularity")
             + F.lit(0.15) * (F.lit(1.0) - _c("risk_score")) + F.lit(0.15) * (F.lit(1.0) - _c(p_col))
             + F.lit(0.10) * (F.lit(1.0) - _c("driver_delay_rate")))
    score = score + F.least(F.lit(0.05), maturity * F.lit(0.004))
    score = score + F.when(peak != 0, F.lit(0.02)).otherwise(F.lit(0.0))
    score = score + F.when(cat == 0, F.lit(0.02)).when(cat == 2, F.lit(-0.02)).otherwise(F.lit(0.0))
    return df.withColumn(out, E.round_even(E.clip(score, 0.0, 1.0), 4))


def elite_target_80(df: DataFrame, p_col: str = K.DELAY_PROB_COL, out: str = "probabilistic_efficiency") -> DataFrame:
    """Older stacked target without maturity, peak and distance terms."""
    score = (F.lit(0.40) * _c("efficiency_score") + F.lit(0.20) * _c("lane_popularity")
             + F.lit(0.15) * (F.lit(1.0) - _c("risk_score")) + F.lit(0.15) * (F.lit(1.0) - _c(p_col))
             + F.lit(0.10) * (F.lit(1.0) - _c("driver_delay_rate")))
    return df.withColumn(out, E.round_even(E.clip(score, 0.0, 1.0), 4))
