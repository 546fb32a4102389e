"""Feature table build (I22 for the 8.1 rules, I19 for the older 7.2.5 rules).

Plan: the raw input is stored once as Parquet; one small aggregation pass gives the global
scalars that the scans need (delay quantile, distance median); the lane scan and the
vehicle scan (``operators/scan.py``) follow, and their result is stored as Parquet in the shared
checkpoint folder.  The remaining scalars (dwell quantile, flag mean, scaler states, risk range, tercile
edges) are aggregations that read only their columns of that table, and the export is a
projection of it with the scalars as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.operators import lanes as L
from lanecast.operators import lifecycle as V
from lanecast.operators import scaling as S
from lanecast.operators import scores as SC
from lanecast.operators.scan import RANGE, exact_quantiles_multi, range_rows
from lanecast.session import stage_table

EXPORT_81 = (
    "BookingID", "vehicle_no", "Origin_Location", "Destination_Location",
    "TRANSPORTATION_DISTANCE_IN_KM", "day_of_week", "month", "delay_flag",
    "lane_popularity", "cost_weight", "risk_score", "driver_delay_rate",
    "route_risk", "confidence_score", "idle_loss", "is_return_trip", "is_deadhead",
    "efficiency_score", "efficiency_label",
    "is_peak_month", "distance_category", "lane_maturity", "is_market",
)
EXPORT_725 = (
    "BookingID", "vehicle_no", "Origin_Location", "Destination_Location",
    "TRANSPORTATION_DISTANCE_IN_KM", "day_of_week", "month", "delay_flag",
    "lane_popularity", "risk_score", "driver_delay_rate",
    "route_risk", "confidence_score", "idle_loss", "is_return_trip", "is_deadhead",
    "efficiency_score", "efficiency_label",
)


@dataclass(frozen=True)
class Profile:
    name: str
    delay_quantile: float
    popularity: str            # "exp" or "linear" recency boost
    popularity_rate: float
    risk_k: float              # Bayesian shrinkage constant
    scale_on: str              # "train" (first 80 % of the sort) or "all"
    weights: SC.ScoreWeights
    export: tuple = field(default=EXPORT_81)
    train_share: float = 0.8
    lane_order: str = "vehicle"     # "time": earlier = earlier start (the sound alternative)
    split_order: str = "vehicle"    # "time": the train rows are the earliest 80 % by start time


PROFILE_81 = Profile("8.1", 0.80, "exp", 0.02, 15.0, "train",
                     SC.ScoreWeights(0.38, 0.20, 0.14, 0.14, 0.09, 0.025, 0.05), EXPORT_81)
PROFILE_725 = Profile("7.2.5", 0.75, "linear", 0.05, 10.0, "all",
                      SC.ScoreWeights(0.40, 0.20, 0.15, 0.15, 0.10, 0.02, None), EXPORT_725)


@dataclass
class FeatureBuild:
    """Result of ``build_features``: the full frame (internal columns kept) and the scalars."""
    frame: DataFrame
    scalars: dict
    profile: Profile

    def export(self) -> DataFrame:
        """B2: the exported column list, plus the booking-type column when present."""
        cols = list(self.profile.export)
        if "Market/Regular" in self.frame.columns:
            cols.append("Market/Regular")
        return self.frame.select(*[F.col(f"`{c}`") for c in cols])


def prepare(trips: DataFrame, profile: Profile = PROFILE_81) -> tuple[DataFrame, dict]:
    """Row-level features and the first scalar pass (D1, D3): delay flag, calendar, distance.

    ``trips`` is read twice, here and by the scans.
    """
    base = V.add_delay_hours(trips)
    # D1 and D3 in one pass over the input
    qs = exact_quantiles_multi(base, {"delay_hours": [profile.delay_quantile],
                                      "TRANSPORTATION_DISTANCE_IN_KM": [0.5]})
    thr, median = qs["delay_hours"][0], qs["TRANSPORTATION_DISTANCE_IN_KM"][0]
    n_rows = qs["_counts"]["delay_hours"]          # delay_hours is never NULL: this is the row count
    df = V.add_delay_flag(base, thr)
    df = V.add_calendar(df)
    df = V.impute_distance(df, median)
    df = V.add_distance_features(df)
    return df, {"delay_threshold": thr, "distance_median": median, "n_rows": n_rows}


def scans(df: DataFrame, profile: Profile = PROFILE_81, **options) -> DataFrame:
    """Lane scan (E3-E5), then vehicle scan (E1, E2 inputs, sort position), the trip links and the lane features.

    The scans need nothing of each other.  Where 'earlier' in a lane means the sort of all trips (the default), the trips
    are shuffled once, to ranges of that sort, and both scans run there; else each scan shuffles them, the lane scan
    first, as its three counts are narrower than the vehicle scan's next trip.  The scanned rows are stored; what follows
    from the columns of a row alone is added by every reader, so neither the shuffles nor the stored table carry it.
    """
    base = df.drop(*V.ROW_FEATURES)
    order = ["vehicle_no", *V.vehicle_order()]
    if L.lane_order(profile.lane_order) == order:       # both scans fit one order of all trips: one shuffle
        ranged, ranges = range_rows(df, order, base.columns, rows_per_chunk=options.get("rows_per_chunk"))
        lane = L.lane_scan(ranged, mode=profile.lane_order, ranges=ranges)
        vehicle = V.vehicle_scan(lane, ranges=ranges).drop(RANGE)
    else:
        lane = L.lane_scan(base, mode=profile.lane_order, **options)
        vehicle = V.vehicle_scan(lane, counted=df, **options)
    scanned = stage_table(vehicle, "scanned-trips")
    veh = V.add_trip_links(V.add_row_features(scanned))
    return L.add_lane_features(veh, profile.popularity, profile.popularity_rate, profile.risk_k)


def build_features(trips: DataFrame, profile: Profile = PROFILE_81, **options) -> FeatureBuild:
    """I22 (profile 8.1) / I19 (profile 7.2.5): raw trips -> feature table.

    ``options`` are those of the scans (``hot_rows``, ``rows_per_chunk``).
    """
    df, scalars = prepare(stage_table(trips, "trips"), profile)
    staged = scans(df, profile, **options)

    n = scalars["n_rows"]
    # One pass over one column each
    flag_mean = staged.agg(F.avg("delay_flag")).first()[0]
    dwell_thr = V.dwell_threshold(staged)
    scalars.update(flag_mean=flag_mean, dwell_threshold=dwell_thr)

    out = V.add_driver_delay_rate(staged, flag_mean)
    out = V.add_continuity(out, dwell_thr)
    if profile.scale_on == "train":
        if profile.split_order == "time":
            out = S.time_sort_position(out)
        out = S.add_train_mask(out, n, profile.train_share)
        fit_rows = F.col("is_train")
    else:
        out = out.withColumn("is_train", F.lit(True))
        fit_rows = None
    state = S.minmax_fit(out, S.PRE_SCALE + ["TRANSPORTATION_DISTANCE_IN_KM"], fit_rows)
    max_dist = state.pop("TRANSPORTATION_DISTANCE_IN_KM")[1]
    out = S.minmax_apply(out, state, S.PRE_SCALE, S.SCALED)
    out = S.add_dist_norm(out, max_dist)
    out = S.add_confidence(out)
    out = S.risk_raw(out)
    risk_state = S.minmax_fit(out, ["risk_score_raw"], fit_rows)
    out = S.minmax_apply(out, risk_state, ["risk_score_raw"], ["risk_score"])
    out = out.withColumn("efficiency_score", SC.efficiency_expr(profile.weights))
    edges = SC.tercile_edges(stage_table(out.select("efficiency_score"), "efficiency"))     # read several times
    out = out.withColumn("efficiency_label", SC.label_expr("efficiency_score", edges))
    out = V.add_market_flag(out, "is_market", 0)
    scalars.update(feature_scaler=state, max_dist=max_dist, risk_scaler=risk_state["risk_score_raw"],
                   tercile_edges=edges, train_rows=int(n * profile.train_share) if fit_rows is not None else n)
    return FeatureBuild(out, scalars, profile)
