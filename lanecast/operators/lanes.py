"""Lane statistics (E3-E5, I9-I12), the lane knowledge base (D5, D6) and lane lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast.functions import expr as E
from lanecast.operators.lane_index import LANE_CTX, LaneIndex, contains_matches, global_context, stored_index
from lanecast.operators.scan import ordered_scan

LANE_KEYS = ["Origin_Location", "Destination_Location"]


def lane_order(mode: str = "vehicle"):
    """Order of 'earlier' trips within a lane.

    ``vehicle`` (default, the reference's behaviour): the vehicle-then-start sort, so
    earlier means earlier vehicles.  ``time``: start time first, the sound alternative.
    """
    v, s, b = "vehicle_no", "trip_start_date", "BookingID"
    return [s, v, b] if mode == "time" else [v, s, b]


def lane_scan(df: DataFrame, *, mode: str = "vehicle", **options) -> DataFrame:
    """E3 position in lane, E4 earlier BookingID count, E5 inputs (earlier flag count/sum).

    Rows with a NULL origin or destination belong to no lane: their lane statistics are NULL.
    """
    scanned = ordered_scan(df, LANE_KEYS, lane_order(mode), counts={"lane_prior_bookings": "BookingID"},
                           sums={"lane_prior_flags": "delay_flag"}, **options)
    in_lane = F.col("Origin_Location").isNotNull() & F.col("Destination_Location").isNotNull()
    return (scanned.withColumn("route_count", F.when(in_lane, F.col("_pos")))
            .withColumn("lane_prior_bookings", F.when(in_lane, F.col("lane_prior_bookings")))
            .withColumn("lane_prior_flags", F.when(in_lane, F.col("lane_prior_flags")))
            .drop("_pos"))


def prior_flag_std(n, k):
    """Sample std of 0/1 flags from count n and flag sum k of the earlier rows; n < 2 -> NULL."""
    nd, kd = n.cast("double"), k.cast("double")
    return F.when(n >= 2, F.sqrt(kd * (nd - kd) / nd / (nd - 1)))


def add_lane_features(df: DataFrame, popularity: str = "exp", rate: float = 0.02, risk_k: float = 15.0) -> DataFrame:
    """I9 maturity, I10 raw popularity, I11 smoothed risk, I12 pre-scale columns.

    popularity ``exp``: count * exp(rate * index) + 1; ``linear``: count * (1 + rate * index) + 1.
    """
    rc = F.col("route_count").cast("double")
    cnt = F.coalesce(F.col("lane_prior_bookings").cast("double"), F.lit(0.0))
    boost = F.exp(F.lit(rate) * rc) if popularity == "exp" else (F.lit(1.0) + F.lit(rate) * rc)
    std = F.coalesce(prior_flag_std(F.col("route_count"), F.col("lane_prior_flags")), F.lit(0.0))
    raw = cnt * boost + F.lit(1.0)
    log_pop = F.log1p(raw)
    if popularity == "exp":
        # count * exp(a) + 1 overflows to +inf once a = rate * index passes ~709 (a lane with ~35,000
        # earlier trips at rate 0.02); log1p of it is then a + log(count + 2 exp(-a)), which is finite.
        a = F.lit(rate) * rc
        log_pop = F.when(raw < F.lit(float("inf")), log_pop).otherwise(a + F.log(cnt + F.lit(2.0) * F.exp(-a)))
    return df.withColumns({
        "lane_maturity": F.log1p(rc), "lane_popularity_raw": raw, "route_risk_raw": std,
        "route_risk_smoothed": std * (rc / (rc + F.lit(risk_k))), "lane_popularity_log": log_pop,
        "cost_weight_raw": F.lit(1.0) / (F.lit(1.0) + F.log1p(F.col("est_fuel_cost") / 1000))})


# --- D5 / D6 --------------------------------------------------------------------------------

KB_MEASURES = ["lane_popularity", "route_risk", "driver_delay_rate"]


def _halves(x: Column) -> tuple[Column, Column]:
    """``x`` as the nearest single-precision value and the rest: sums of the first are exact, so that a mean hardly depends
    on the order of its rows."""
    small = F.abs(x) < F.lit(1e38)
    high = F.when(small, x.cast("float").cast("double")).otherwise(x)
    return high, F.when(small, x - high).otherwise(F.lit(0.0))


def lane_kb(features: DataFrame) -> DataFrame:
    """Per (origin key, destination key) means and trip count.

    The trips are summed up by their place names first, so that a name is cut into its key once and not once a trip.
    """
    means = {**{m: m for m in KB_MEASURES}, "avg_dist_km": "TRANSPORTATION_DISTANCE_IN_KM"}
    parts = [F.count(F.lit(1)).alias("trip_count")]
    for name, column in means.items():
        high, low = _halves(F.col(column).cast("double"))
        parts += [F.sum(high).alias(f"high_{name}"), F.sum(low).alias(f"low_{name}"), F.count(column).alias(f"n_{name}")]
    named = features.select(*LANE_KEYS, *means.values()).groupBy(*LANE_KEYS).agg(*parts)
    mean = {name: F.try_divide(F.sum(f"high_{name}") + F.sum(f"low_{name}"), F.sum(f"n_{name}")).alias(name) for name in means}
    return (named.withColumns({"ok": E.city_key("Origin_Location"), "dk": E.city_key("Destination_Location")})
            .groupBy("ok", "dk")
            .agg(*[mean[m] for m in KB_MEASURES], F.sum("trip_count").alias("trip_count"), mean["avg_dist_km"]))


def lane_kb_global(features: DataFrame) -> DataFrame:
    """The same means over all trips, trip_count 0 (one row)."""
    return features.agg(*[F.avg(m).alias(m) for m in KB_MEASURES],
                        F.lit(0).cast("long").alias("trip_count"),
                        F.avg("TRANSPORTATION_DISTANCE_IN_KM").alias("avg_dist_km"))


# --- C1 - C3 ---------------------------------------------------------------------------------

def resolve_pairs(pairs: DataFrame, index: LaneIndex) -> DataFrame:
    """C1-C3 on distinct (ok, dk) keys: exact KB key, else the first KB lane in key order whose keys
    contain both names, else the global averages.  Returns ok, dk, lane_match and the lane context.

    One path at every size over the stored index; the planner and AQE choose the joins, and no job runs while the plan
    is built.
    """
    exact = index.lanes.select("ok", "dk", F.struct(*LANE_CTX).alias("_exact"))
    step = pairs.join(exact, ["ok", "dk"], "left")
    first = contains_matches(step.where(F.col("_exact").isNull()).select("ok", "dk"), index)
    lane = index.lanes.select(F.struct(F.col("ok").alias("k_ok"), F.col("dk").alias("k_dk")).alias("_first"),
                              F.struct(*LANE_CTX).alias("_contains"))
    found = first.join(lane, "_first").select("ok", "dk", "_contains")
    fallback = global_context(index.fallback)
    out = step.join(found, ["ok", "dk"], "left").withColumn("_ctx", F.coalesce("_exact", "_contains", fallback))
    match = (F.when(F.col("_exact").isNotNull(), F.lit("exact"))
             .when(F.col("_contains").isNotNull(), F.lit("contains")).otherwise(F.lit("global")))
    return out.select("ok", "dk", match.alias("lane_match"), *[F.col("_ctx")[c].alias(c) for c in LANE_CTX])


def lookup_lane(requests: DataFrame, kb: DataFrame | LaneIndex, global_row: DataFrame | None = None, *,
                origin: str = "origin", destination: str = "destination", names: DataFrame | None = None) -> DataFrame:
    """C1 exact key, C2 first KB lane (key order) containing both names, C3 global averages.

    Adds ``lane_match`` (exact / contains / global) and the five lane-context columns.  The three tiers are resolved
    once per distinct (origin key, destination key) pair, and the resolved pairs are joined back to the requests in one
    equi-join.  ``kb`` is a stored index, or the knowledge base (one row per (ok, dk)) with its ``global_row``, whose
    index is then stored or found.  A request without one of the names gets the global row.  ``names`` are the rows
    that the distinct pairs come from, where a plainer plan than that of ``requests`` has the same names.
    """
    index = kb if isinstance(kb, LaneIndex) else stored_index(kb, global_row)
    ok, dk = E.place_key(origin), E.place_key(destination)
    req = requests.withColumn("_ok", ok).withColumn("_dk", dk)
    pairs = (requests if names is None else names).select(ok.alias("ok"), dk.alias("dk")).where(
        F.col("ok").isNotNull() & F.col("dk").isNotNull()).distinct()
    ctx = resolve_pairs(pairs, index).withColumnRenamed("ok", "_ok").withColumnRenamed("dk", "_dk")
    out = req.join(ctx, ["_ok", "_dk"], "left").drop("_ok", "_dk")
    fallback = global_context(index.fallback)
    missing = F.col("lane_match").isNull()
    return out.withColumns({c: F.when(missing, fallback[c]).otherwise(F.col(c)) for c in LANE_CTX}
                           | {"lane_match": F.coalesce("lane_match", F.lit("global"))})
