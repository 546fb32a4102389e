"""J18 quote_requests: requests -> priced quotes (and a rejected table).

Plan: validation and normalisation are row-local.  The lane context is resolved once per distinct (origin, destination)
pair through the stored lane index (exact key; else the pair's shortest posting list, whose lanes are checked in place;
else the global row) and joined back on the pair.  Where one pair has a large share of the requests, AQE splits that
join's request side.  Requests with coordinates of their own are shuffled once more, for their road distance.  The
gazetteer joins are broadcast (fixed size); everything after that is per-row column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.functions import expr as E
from lanecast.operators import lanes as L
from lanecast.operators import pricing as P
from lanecast.operators import requests as R

Scorer = Callable[[DataFrame], DataFrame]
Store = Callable[[DataFrame, str], DataFrame]       # a stage boundary with its name, as ``stage_table``


def given_scores(p_col: str = "p_delay", eff_col: str = "eff") -> Scorer:
    """Scorer that takes the two model outputs from columns of the request table."""
    def score(df: DataFrame) -> DataFrame:
        return (df.withColumn("delay_probability", F.col(p_col).cast("double"))
                .withColumn("efficiency_score", E.clip(F.col(eff_col).cast("double"), 0.0, 1.0)))
    return score


def prepare_requests(requests: DataFrame, kb: DataFrame | L.LaneIndex, kb_global: DataFrame | None = None, road: DataFrame | None = None,
                     clamp: bool = False, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """B4, B5, (B6), lane context, distance and temporal: everything before the model.

    ``requests`` are read several times.  The lanes are looked up for the valid requests as they come, so that the
    distinct names do not wait for the road join; what follows from a row alone is added after the last shuffle.
    ``store`` keeps the valid requests, so that they are checked once, and the rows after the last shuffle."""
    valid, rejected = R.validate_requests(requests)
    if store:
        valid = store(R.normalize_requests(valid), "valid-requests")
        req = P.add_request_road(valid, road)
    else:
        req = R.normalize_requests(P.add_request_road(valid, road))
    if clamp:
        req = R.clamp_weight(req)
    req = L.lookup_lane(req, kb, kb_global, names=valid)
    req = P.add_distance(req, requests.sparkSession, road)
    if store:
        req = store(req, "located-requests")
    req = req.withColumn("trip_day", R.parse_trip_date("trip_date"))
    return P.add_temporal(req), rejected


def price(scored: DataFrame) -> DataFrame:
    """J5 - J15 on scored requests."""
    out = P.add_p_return(scored)
    out = P.add_confidence(out)
    out = out.withColumn("efficiency_label", E.efficiency_band("efficiency_score"))
    out = P.add_pricing(out)
    return P.add_addons(out)


def quote_requests(requests: DataFrame, kb: DataFrame | L.LaneIndex, kb_global: DataFrame | None = None,
                   scorer: Scorer | None = None,
                   road: DataFrame | None = None, clamp: bool = False, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """(quotes with all intermediate columns, rejected requests with reasons).

    ``kb`` is a stored lane index, or the knowledge base with its global row.  With ``store`` (see ``prepare_requests``)
    the quotes are expressions over stored rows, so that a reader of some columns works out no others."""
    req, rejected = prepare_requests(requests, kb, kb_global, road, clamp, store)
    scored = (scorer or given_scores())(req)
    return price(scored), rejected


FLAT_2DP = ["c_base", "c_risk", "p_min", "p_max", "floor", "ceiling", "c_survival", "recommended_price"]


def flat_quotes(q: DataFrame) -> DataFrame:
    """Scalar view of a quote, with the document's rounding."""
    r2 = {k: E.py_round(F.col(k), 2) for k in FLAT_2DP}
    return q.select(
        "request_id", "origin", "destination", F.col("formatted_date").alias("trip_date"), "weight_tonnes",
        "vehicle_type", "lane_match", "distance_km", "distance_method", "season", "day_name",
        E.py_round(F.col("efficiency_score"), 4).alias("efficiency_score"), "efficiency_label",
        E.py_round(F.col("delay_probability"), 4).alias("delay_probability"),
        E.py_round(F.col("p_return"), 4).alias("p_return"), "confidence_score", "confidence_label",
        F.col("p_return_model.arrival_time").alias("arrival_time"),
        F.col("p_return_model.T_active_h").alias("T_active_h"),
        *[r2[k].alias(k) for k in FLAT_2DP], "is_feasible", "status", "addon_total", "final_price")


def quote_document(q: DataFrame) -> DataFrame:
    """A10 layout: nested quote document per request."""
    r2 = lambda x: E.py_round(F.col(x), 2)
    operational = F.struct(
        r2("fuel_loaded_L").alias("fuel_loaded_L"), r2("fuel_empty_L").alias("fuel_empty_L"),
        r2("fuel_loaded_cost").alias("fuel_loaded_cost"), r2("fuel_empty_cost").alias("fuel_empty_cost"),
        r2("tolls").alias("tolls_roundtrip"), r2("wages").alias("driver_wage"), r2("maintenance").alias("maintenance"),
        F.col("mobilization").alias("mobilization"), r2("c_base").alias("c_base"),
        r2("m_loaded").alias("m_loaded_kmpl"), r2("m_empty").alias("m_empty_kmpl"), r2("diesel_price").alias("diesel_price"))
    risk = F.struct(E.py_round(F.col("p_return"), 4).alias("p_return"),
                    E.py_round(F.lit(1.0) - F.col("p_return"), 4).alias("p_no_return"),
                    r2("fuel_empty_cost").alias("empty_fuel_val"), r2("c_risk").alias("c_risk"))
    corridor = F.struct(
        r2("p_min").alias("p_min"), r2("p_max").alias("p_max"), r2("premium").alias("premium"),
        r2("floor").alias("floor"), r2("ceiling").alias("ceiling"), F.col("was_snapped").alias("was_snapped"),
        F.when(F.col("competitor_price").isNotNull() & (F.col("competitor_price") != 0),
               r2("competitor_price")).alias("competitor_price"),
        F.lit(12.0).alias("epsilon_high_pct"), F.lit(10.0).alias("epsilon_low_pct"),
        E.py_round(F.col("ml_multiplier"), 3).alias("ml_multiplier"),
        E.py_round(F.col("ml_delay_premium") * 100, 1).alias("ml_delay_prem_pct"),
        E.py_round(F.col("ml_eff_adjustment") * 100, 1).alias("ml_eff_adj_pct"))
    feasibility = F.struct(r2("c_survival").alias("c_survival"), F.col("is_feasible").alias("is_feasible"),
                           r2("recommended").alias("recommended"), F.col("status").alias("status"),
                           E.survival_note("is_feasible", "c_survival").alias("note"))
    pricing = F.struct(operational.alias("operational"), risk.alias("risk"), corridor.alias("corridor"),
                       feasibility.alias("feasibility"), F.col("recommended_price").alias("recommended_price"),
                       F.col("status").alias("status"))
    return q.select(
        "request_id", "origin", "destination", F.col("formatted_date").alias("trip_date"), "weight_tonnes",
        "vehicle_type", P.abstraction(q).alias("abstraction"),
        E.py_round(F.col("efficiency_score"), 4).alias("efficiency_score"), "efficiency_label",
        E.py_round(F.col("delay_probability"), 4).alias("delay_probability"),
        E.py_round(F.col("p_return"), 4).alias("p_return"), "p_return_model",
        "confidence_score", "confidence_label", pricing.alias("pricing"),
        F.struct(F.col("addons").alias("selected"), F.col("addon_breakdown").alias("breakdown"),
                 F.col("addon_total").alias("total")).alias("addons"),
        "final_price", "status")
