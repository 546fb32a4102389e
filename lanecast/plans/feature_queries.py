"""Registered queries over the trips view: sources, windows, features and feature aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast import oracle as O
from lanecast.functions import expr as E
from lanecast.operators import aggregates as AG
from lanecast.operators import lanes as L
from lanecast.operators import lifecycle as V
from lanecast.operators import scaling as S
from lanecast.operators import scores as SC
from lanecast.plans.features import PROFILE_81, PROFILE_725, build_features, prepare
from lanecast.plans.cache import memo
from lanecast.registry import register
from lanecast.session import stage_table
from lanecast.sources import trips as TR
from lanecast.streaming.quotes import scratch_dir

S81 = O.features_sql(O.P81)
S725 = O.features_sql(O.P725)
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _feat(spark: SparkSession, sf_dir: str, profile=PROFILE_81):
    return memo(spark, ("features", sf_dir, profile.name),
                lambda: build_features(TR.load_trips(spark, sf_dir), profile))


def _from_features(select: str, where: str = "", src: str = "features", sql=S81) -> str:
    return f"WITH {sql} SELECT {select} FROM {src} {where}"


def _one_row(spark: SparkSession, values: dict, types: dict) -> DataFrame:
    schema = ", ".join(f"`{k}` {types[k]}" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema)


BK = ("BookingID", "s")

# --- A: sources ---------------------------------------------------------------------------

A1 = [BK, ("vehicle_no", "s"), ("Origin_Location", "s"), ("Destination_Location", "s"),
      ("TRANSPORTATION_DISTANCE_IN_KM", "d"), ("Market/Regular", "s")]


@register("A1_scan_trips", A1, lambda s: f"WITH {O.trips_sql()} SELECT {s} FROM trips_raw")
def q_a1(spark, sf_dir):
    """A1: the raw trips as CSV files with shuffled and extra columns, read back by header name."""
    trips = TR.trips_view(spark, sf_dir)
    cols = sorted(trips.columns, reverse=True)
    path = scratch_dir(spark, "trips-csv")
    TR.write_features(trips.select(F.lit("x").alias("extra"), *[f"`{c}`" for c in cols]), path, fmt="csv")
    return TR.scan_trips(spark, path)


@register("A2_trim_columns", A1, lambda s: f"WITH {O.trips_sql()} SELECT {s} FROM trips_raw")
def q_a2(spark, sf_dir):
    """A2: header names with white space around them, trimmed."""
    trips = TR.trips_view(spark, sf_dir)
    return TR.trim_columns(trips.toDF(*[f"  {c}\t" for c in trips.columns]))


A3 = [BK] + [(f"{c}_us", "i") for c in ("trip_start_date", "trip_end_date", "Planned_ETA", "actual_eta")]


@register("A3_coerce_timestamps", A3, lambda s: (
    f"WITH {O.trips_sql()}, t AS (SELECT BookingID, "
    + ", ".join(f"datediff('microsecond', TIMESTAMP '1970-01-01 00:00:00', {c}) AS {c}_us"
                for c in ("trip_start_date", "trip_end_date", "Planned_ETA", "actual_eta"))
    + f" FROM trips_raw) SELECT {s} FROM t"))
def q_a3(spark, sf_dir):
    """A3: date text parsed to TIMESTAMP_NTZ (shown as microseconds since 1970-01-01)."""
    df = TR.load_trips(spark, sf_dir)
    return df.select("BookingID", *[F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col(c)).alias(f"{c}_us")
                                    for c in ("trip_start_date", "trip_end_date", "Planned_ETA", "actual_eta")])


# --- B ---------------------------------------------------------------------------------------

@register("B1_drop_missing", [BK, ("TRANSPORTATION_DISTANCE_IN_KM", "d")],
          lambda s: f"WITH {O.trips_sql()} SELECT {s} FROM trips_raw WHERE TRANSPORTATION_DISTANCE_IN_KM IS NOT NULL "
                    f"AND NOT isnan(TRANSPORTATION_DISTANCE_IN_KM)")
def q_b1(spark, sf_dir):
    """B1: rows with a missing distance dropped (NULL or NaN)."""
    return AG.drop_missing(TR.load_trips(spark, sf_dir), ["TRANSPORTATION_DISTANCE_IN_KM"])


@register("B8_market_flag", [BK, ("is_market", "i")],
          lambda s: f"WITH {O.trips_sql()}, t AS (SELECT BookingID, CAST(coalesce({O.strip(chr(34) + 'Market/Regular' + chr(34))}"
                    f" = 'Regular', false) AS INTEGER) AS is_market FROM trips_raw) SELECT {s} FROM t")
def q_b8(spark, sf_dir):
    """Booking-type flag from the stripped text."""
    return V.add_market_flag(TR.load_trips(spark, sf_dir)).select("BookingID", "is_market")


# --- H over trips ----------------------------------------------------------------------------

@register("H1_city_key", [BK, ("origin_key", "s"), ("dest_key", "s")],
          lambda s: f"WITH {O.trips_sql()}, t AS (SELECT BookingID, {O.city_key('Origin_Location')} AS origin_key, "
                    f"{O.city_key('Destination_Location')} AS dest_key FROM trips_raw) SELECT {s} FROM t")
def q_h1(spark, sf_dir):
    """H1: lane keys from the address text."""
    df = TR.load_trips(spark, sf_dir)
    return df.select("BookingID", E.city_key("Origin_Location").alias("origin_key"),
                     E.city_key("Destination_Location").alias("dest_key"))


@register("H3_hours_between", [BK, ("trip_hours", "d"), ("delay_hours_raw", "d")],
          lambda s: f"WITH {O.trips_sql()}, t AS (SELECT BookingID, {O.hours('trip_start_date', 'trip_end_date')} AS trip_hours, "
                    f"{O.hours('Planned_ETA', 'actual_eta')} AS delay_hours_raw FROM trips_raw) SELECT {s} FROM t")
def q_h3(spark, sf_dir):
    """H3: fractional hours between two timestamps."""
    df = TR.load_trips(spark, sf_dir)
    return df.select("BookingID", E.hours_between("trip_start_date", "trip_end_date").alias("trip_hours"),
                     E.hours_between("Planned_ETA", "actual_eta").alias("delay_hours_raw"))


@register("H4_calendar", [BK, ("month", "i"), ("day_of_week", "i"), ("is_peak_month", "i")],
          lambda s: f"WITH {O.trips_sql()}, t AS (SELECT BookingID, month(trip_start_date) AS month, "
                    f"isodow(trip_start_date) - 1 AS day_of_week, CAST(coalesce(month(trip_start_date) IN (10, 11, 12), "
                    f"false) AS INTEGER) AS is_peak_month FROM trips_raw) SELECT {s} FROM t")
def q_h4(spark, sf_dir):
    """H4: month, weekday (Monday = 0), peak-month flag."""
    return V.add_calendar(TR.load_trips(spark, sf_dir)).select("BookingID", "month", "day_of_week", "is_peak_month")


# --- D: scalar aggregates -------------------------------------------------------------------

def _delay_hours(spark, sf_dir):
    """The delay hours of all trips, stored, as a quantile reads them several times."""
    return stage_table(V.add_delay_hours(TR.load_trips(spark, sf_dir)).select("delay_hours"), "delay-hours")


@register("D1_delay_threshold", [("delay_threshold", "d")],
          lambda s: _from_features(s, src="(SELECT thr AS delay_threshold FROM f_s1)"))
def q_d1(spark, sf_dir):
    """Exact linear-interpolated 0.80 quantile of delay hours over all trips."""
    base = _delay_hours(spark, sf_dir)
    return _one_row(spark, {"delay_threshold": V.delay_threshold(base, 0.80)}, {"delay_threshold": "double"})


@register("D2_dwell_threshold", [("dwell_threshold", "d")],
          lambda s: _from_features(s, src="(SELECT dwell_thr AS dwell_threshold FROM f_s2)"))
def q_d2(spark, sf_dir):
    """max(48, 0.90 quantile of dwell hours)."""
    b = _feat(spark, sf_dir)
    return _one_row(spark, {"dwell_threshold": b.scalars["dwell_threshold"]}, {"dwell_threshold": "double"})


@register("D3_distance_median", [("distance_median", "d")],
          lambda s: _from_features(s, src="(SELECT med AS distance_median FROM f_s1)"))
def q_d3(spark, sf_dir):
    """D3: median of the known distances (used to impute the missing ones)."""
    base = stage_table(TR.load_trips(spark, sf_dir).select("TRANSPORTATION_DISTANCE_IN_KM"), "distances")
    return _one_row(spark, {"distance_median": V.distance_median(base)}, {"distance_median": "double"})


@register("D4_flag_mean", [("flag_mean", "d")],
          lambda s: _from_features(s, src="(SELECT flag_mean FROM f_s2)"))
def q_d4(spark, sf_dir):
    """Global mean of the delay flag (default rate of a vehicle's first trip)."""
    base = _delay_hours(spark, sf_dir)
    thr = V.delay_threshold(base, 0.80)
    return V.add_delay_flag(base, thr).agg(F.avg("delay_flag").alias("flag_mean"))


KB = [("ok", "s"), ("dk", "s"), ("lane_popularity", "d"), ("route_risk", "d"), ("driver_delay_rate", "d"),
      ("trip_count", "i"), ("avg_dist_km", "d")]
KB_SQL = (f"{S81}, kb AS (SELECT {O.city_key('Origin_Location')} AS ok, {O.city_key('Destination_Location')} AS dk, "
          "avg(lane_popularity) AS lane_popularity, avg(route_risk) AS route_risk, "
          "avg(driver_delay_rate) AS driver_delay_rate, count(*) AS trip_count, "
          "avg(TRANSPORTATION_DISTANCE_IN_KM) AS avg_dist_km FROM features GROUP BY 1, 2), "
          "kb_global AS (SELECT avg(lane_popularity) AS lane_popularity, avg(route_risk) AS route_risk, "
          "avg(driver_delay_rate) AS driver_delay_rate, CAST(0 AS BIGINT) AS trip_count, "
          "avg(TRANSPORTATION_DISTANCE_IN_KM) AS avg_dist_km FROM features)")


@register("D5_lane_kb", KB, lambda s: f"WITH {KB_SQL} SELECT {s} FROM kb")
def q_d5(spark, sf_dir):
    """Lane knowledge base keyed by (origin key, destination key)."""
    return L.lane_kb(_feat(spark, sf_dir).export())


@register("D6_lane_kb_global", KB[2:], lambda s: f"WITH {KB_SQL} SELECT {s} FROM kb_global")
def q_d6(spark, sf_dir):
    """Global lane averages with trip_count 0."""
    return L.lane_kb_global(_feat(spark, sf_dir).export())


D7 = [(f"{m}_{c}", "d") for c in S.PRE_SCALE for m in ("min", "max")]


@register("D7_minmax_fit", D7, lambda s: _from_features(s, src="f_fit"))
def q_d7(spark, sf_dir):
    """Min and max of the four pre-scale columns on the train rows."""
    st = _feat(spark, sf_dir).scalars["feature_scaler"]
    vals = {f"{m}_{c}": st[c][0 if m == "min" else 1] for c in S.PRE_SCALE for m in ("min", "max")}
    return _one_row(spark, vals, {k: "double" for k in vals})


@register("D8_max_distance", [("max_dist", "d")], lambda s: _from_features(s, src="f_fit"))
def q_d8(spark, sf_dir):
    """Largest distance on the train rows."""
    return _one_row(spark, {"max_dist": _feat(spark, sf_dir).scalars["max_dist"]}, {"max_dist": "double"})


D9 = [("e0", "d"), ("e1", "d"), ("e2", "d"), ("e3", "d")]


@register("D9_tercile_edges", D9, lambda s: _from_features(
    s, src="(SELECT min(efficiency_score) AS e0, quantile_cont(efficiency_score, CAST(1.0/3.0 AS DOUBLE)) AS e1, "
           "quantile_cont(efficiency_score, CAST(2.0/3.0 AS DOUBLE)) AS e2, max(efficiency_score) AS e3 FROM f_eff2)"))
def q_d9(spark, sf_dir):
    """Tercile edges (0, 1/3, 2/3, 1 quantiles) of the efficiency score."""
    e = _feat(spark, sf_dir).scalars["tercile_edges"]
    return _one_row(spark, {"e0": e[0], "e1": e[1], "e2": e[2], "e3": e[3]}, {k: "double" for k, _ in D9})


D10 = [("feature", "s"), ("mean", "d"), ("std", "d"), ("min", "d"), ("max", "d")]
D10_COLS = ["efficiency_score", "lane_popularity", "risk_score", "lane_maturity"]


@register("D10_describe_features", D10, lambda s: _from_features(
    s, src="(" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max "
        f"FROM features" for c in D10_COLS) + ")"))
def q_d10(spark, sf_dir):
    """Mean, sample std, min and max of four exported columns."""
    return AG.describe(_feat(spark, sf_dir).export(), D10_COLS)


D11 = [("total_trips", "i"), ("train_rows", "i"), ("test_rows", "i"), ("delay_rate", "d"), ("peak_share", "d"),
       ("short_share", "d"), ("medium_share", "d"), ("long_share", "d")]


@register("D11_pipeline_report", D11, lambda s: _from_features(
    s, src="(SELECT count(*) AS total_trips, CAST(floor(CAST(count(*) AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS train_rows, "
           "count(*) - CAST(floor(CAST(count(*) AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS test_rows, "
           "avg(delay_flag) AS delay_rate, avg(is_peak_month) AS peak_share, "
           "avg(CAST(distance_category = 0 AS INTEGER)) AS short_share, avg(CAST(distance_category = 1 AS INTEGER)) AS medium_share, "
           "avg(CAST(distance_category = 2 AS INTEGER)) AS long_share FROM features)"))
def q_d11(spark, sf_dir):
    """Row counts, train/test split sizes, delay rate, peak share, distance-category shares."""
    b = _feat(spark, sf_dir)
    return AG.pipeline_report(b.export(), b.scalars["train_rows"])


# --- E: windows ----------------------------------------------------------------------------

@register("E1_next_trip", [BK, ("next_origin", "s"), ("next_dest", "s"), ("next_start_time", "t")],
          lambda s: _from_features(s, src="f_veh"))
def q_e1(spark, sf_dir):
    """Next origin, destination and start of the same vehicle (lead over the vehicle order)."""
    return _feat(spark, sf_dir).frame


def _feature_col_query(key, cols, src="features", profile_sql=S81, doc=""):
    spec = [BK] + cols

    def fn(spark, sf_dir):
        return _feat(spark, sf_dir).frame
    fn.__doc__ = doc
    register(key, spec, lambda s: _from_features(s, src=src, sql=profile_sql))(fn)


_feature_col_query("E2_driver_delay_rate", [("driver_delay_rate", "d")], "f_split",
                   doc="E2: mean delay flag of the vehicle's earlier trips, else the global mean.")
_feature_col_query("E3_lane_trip_index", [("route_count", "i")], "f_lane0",
                   doc="E3: 0-based position of the trip within its lane.")
_feature_col_query("E4_lane_prior_count", [("lane_prior_bookings", "i")], "(SELECT *, lp_bookings AS lane_prior_bookings FROM f_lane0)",
                   doc="E4: count of non-NULL BookingID on earlier trips of the lane.")
_feature_col_query("E5_lane_prior_std", [("route_risk_raw", "d")], "f_lane",
                   doc="E5: sample std of the earlier delay flags of the lane (< 2 rows -> 0).")
_feature_col_query("E6_train_mask", [("is_train", "b")], "f_split",
                   doc="E6: first 80 % of the (vehicle, start, BookingID) sort are train rows.")
_feature_col_query("F1_sort_trips", [("sort_position", "i")], "f_veh",
                   doc="F1: 0-based position in the (vehicle, start NULLs last, BookingID) sort.")
_feature_col_query("I1_delay_label", [("delay_hours", "d"), ("delay_flag", "i")], "f_prep",
                   doc="I1: delay hours (missing -> 0) and flag strictly above the 0.80 quantile.")
_feature_col_query("I2_distance_category", [("TRANSPORTATION_DISTANCE_IN_KM", "d"), ("distance_category", "i")], "f_prep2",
                   doc="I2: imputed distance and its short/medium/long category.")
_feature_col_query("I3_fuel_cost", [("est_fuel_cost", "d")], "f_prep2", doc="I3: km / 3.5 x 87.67.")
_feature_col_query("I4_is_return_trip", [("is_return_trip", "i")], "f_links", doc="I4: return-trip flag.")
_feature_col_query("I5_is_deadhead", [("is_deadhead", "i")], "f_links2", doc="I5: deadhead flag.")
_feature_col_query("I6_dwell_hours", [("dwell_time_hrs", "d")], "f_links", doc="I6: dwell hours before the next trip.")
_feature_col_query("I7_idle_loss_raw", [("idle_loss_raw", "d")], "f_links2", doc="I7: log1p(dwell) x fuel / 100.")
_feature_col_query("I8_is_continuous", [("is_continuous", "b")], "f_split", doc="I8: dwell below the continuity threshold.")
_feature_col_query("I9_lane_maturity", [("lane_maturity", "d")], "f_lane", doc="I9: log1p(lane position).")
_feature_col_query("I10_lane_popularity_raw", [("lane_popularity_raw", "d")], "f_lane",
                   doc="I10: earlier bookings x exp(0.02 x position) + 1.")
_feature_col_query("I11_route_risk_smoothed", [("route_risk_smoothed", "d")], "f_lane",
                   doc="I11: prior std shrunk by n / (n + 15).")
_feature_col_query("I12_pre_scale", [("lane_popularity_log", "d"), ("cost_weight_raw", "d")], "f_lane2",
                   doc="I12: log1p(popularity) and 1 / (1 + log1p(fuel / 1000)).")
_feature_col_query("I13_minmax_apply", [("lane_popularity", "d"), ("cost_weight", "d"), ("idle_loss", "d"), ("route_risk", "d")],
                   "f_scaled", doc="I13: min-max scaled with the train-row state, no clipping.")
_feature_col_query("I14_dist_norm", [("dist_norm", "d")], "f_scaled", doc="I14: km / train max km.")
_feature_col_query("I15_confidence", [("confidence_score", "d")], "f_risk", doc="I15: 1 - scaled route risk.")
_feature_col_query("I16_risk_score", [("risk_score_raw", "d"), ("risk_score", "d")], "f_eff",
                   doc="I16: weighted risk, min-max scaled on train rows.")
_feature_col_query("I17_efficiency_score", [("efficiency_score", "d")], "f_eff2", doc="I17: rule-based efficiency score.")
_feature_col_query("I18_efficiency_label", [("efficiency_label", "s")], "features", doc="I18: tercile label of the score.")



@register("E1_next_trip_split_keys", [BK, ("next_origin", "s"), ("next_start_time", "t"), ("sort_position", "i"),
                                      ("veh_prior_flags", "i")], lambda s: _from_features(s, src="f_veh"))
def q_e1_split(spark, sf_dir):
    """E1, E2 and F1 with every vehicle of over 100 trips split over chunks of 5,000 rows, as a hot key is."""
    df, _ = prepare(stage_table(TR.load_trips(spark, sf_dir), "trips"))
    return V.vehicle_scan(df, hot_rows=100, rows_per_chunk=5_000).withColumnRenamed("_veh_prior_flags", "veh_prior_flags")


@register("E3_lane_scan_split_keys", [BK, ("route_count", "i"), ("lp_bookings", "i"), ("route_risk_raw", "d")],
          lambda s: _from_features(s, src="f_lane"))
def q_e3_split(spark, sf_dir):
    """E3-E5 with every lane of over 1,000 trips split over chunks of 5,000 rows, as a hot key is."""
    df, _ = prepare(stage_table(TR.load_trips(spark, sf_dir), "trips"))
    lanes = L.add_lane_features(L.lane_scan(df, hot_rows=1_000, rows_per_chunk=5_000))
    return lanes.withColumnRenamed("lane_prior_bookings", "lp_bookings")


EXPORT_SPEC_81 = [BK, ("vehicle_no", "s"), ("Origin_Location", "s"), ("Destination_Location", "s"),
                  ("TRANSPORTATION_DISTANCE_IN_KM", "d"), ("day_of_week", "i"), ("month", "i"), ("delay_flag", "i"),
                  ("lane_popularity", "d"), ("cost_weight", "d"), ("risk_score", "d"), ("driver_delay_rate", "d"),
                  ("route_risk", "d"), ("confidence_score", "d"), ("idle_loss", "d"), ("is_return_trip", "i"),
                  ("is_deadhead", "i"), ("efficiency_score", "d"), ("efficiency_label", "s"), ("is_peak_month", "i"),
                  ("distance_category", "i"), ("lane_maturity", "d"), ("is_market", "i"), ("Market/Regular", "s")]
_NOT_725 = {"cost_weight", "is_peak_month", "distance_category", "lane_maturity", "is_market"}
EXPORT_SPEC_725 = [c for c in EXPORT_SPEC_81 if c[0] not in _NOT_725]


@register("I22_build_features", EXPORT_SPEC_81, lambda s: _from_features(s))
def q_i22(spark, sf_dir):
    """Raw trips -> exported 8.1 feature table."""
    return _feat(spark, sf_dir).export()


@register("I19_profile_725", EXPORT_SPEC_725, lambda s: _from_features(s, sql=S725))
def q_i19(spark, sf_dir):
    """The older 7.2.5 rules end to end (q0.75, linear recency, k=10, scaling on all rows)."""
    return _feat(spark, sf_dir, PROFILE_725).export()


@register("A4_feature_table", EXPORT_SPEC_81, lambda s: _from_features(s))
def q_a4(spark, sf_dir):
    """A4: the feature table written with its chosen columns and read back."""
    build, path = _feat(spark, sf_dir), scratch_dir(spark, "features")
    TR.write_features(build.frame, path, [f"`{c}`" for c in build.export().columns])
    return TR.read_features(spark, path)


@register("A5_scaler_state", D7, lambda s: _from_features(s, src="f_fit"))
def q_a5(spark, sf_dir):
    """A5: the fitted min-max state saved and loaded."""
    path = scratch_dir(spark, "scaler")
    S.save_scaler(spark, _feat(spark, sf_dir).scalars["feature_scaler"], path)
    st = S.load_scaler(spark, path)
    vals = {f"{m}_{c}": st[c][0 if m == "min" else 1] for c in S.PRE_SCALE for m in ("min", "max")}
    return _one_row(spark, vals, {k: "double" for k in vals})


@register("B2_project_export", EXPORT_SPEC_81, lambda s: _from_features(s))
def q_b2(spark, sf_dir):
    """B2: the export columns of the 8.1 rules, internal columns left out."""
    out = _feat(spark, sf_dir).export()
    if [c for c, _ in EXPORT_SPEC_81] != out.columns:
        raise ValueError(f"unexpected export columns {out.columns}")
    return out


B3 = [BK] + [(c, "d") for c in ("TRANSPORTATION_DISTANCE_IN_KM", "day_of_week", "month", "lane_popularity", "route_risk",
                                "driver_delay_rate", "is_return_trip", "is_deadhead", "is_peak_month",
                                "distance_category", "lane_maturity", "is_market")]


@register("B3_select_features", B3, lambda s: _from_features(s))
def q_b3(spark, sf_dir):
    """The model's feature columns that the table has."""
    from lanecast.plans.training import select_features
    out = _feat(spark, sf_dir).export()
    return out.select("BookingID", *select_features(out))


B7 = [BK, ("delay_hours", "d"), ("is_market", "i"), ("is_regular", "i"), ("distance_category", "i")]


@register("B7_default_columns", B7, lambda s: (
    f"WITH {O.trips_sql()}, t AS (SELECT BookingID, 0 AS delay_hours, 0 AS is_market, 1 AS is_regular, "
    f"CASE WHEN TRANSPORTATION_DISTANCE_IN_KM < 200 THEN 0 WHEN TRANSPORTATION_DISTANCE_IN_KM < 500 THEN 1 ELSE 2 END "
    f"AS distance_category FROM trips_raw) SELECT {s} FROM t"))
def q_b7(spark, sf_dir):
    """Trips without the optional columns: no delay, not market, regular."""
    df = TR.load_trips(spark, sf_dir).drop("actual_eta", "Planned_ETA", "Market/Regular")
    df = V.add_distance_features(V.add_delay_hours(df))
    return V.add_market_flag(V.add_market_flag(df, "is_market", 0), "is_regular", 1)


_KM = "TRANSPORTATION_DISTANCE_IN_KM"
H9 = [BK, ("log1p_km", "d"), ("exp_km", "d"), ("clip_km", "d"), ("clip_low", "d"), ("clip_high", "d")]


@register("H9_log1p_exp_clip", H9, lambda s: (
    f"WITH {O.trips_sql()}, t AS (SELECT BookingID, ln(1 + {_KM}) AS log1p_km, exp(-{_KM} / 1000) AS exp_km, "
    f"CASE WHEN {_KM} < 200 THEN 200 WHEN {_KM} > 500 THEN 500 ELSE {_KM} END AS clip_km, "
    f"CASE WHEN {_KM} < 200 THEN 200 ELSE {_KM} END AS clip_low, "
    f"CASE WHEN {_KM} > 500 THEN 500 ELSE {_KM} END AS clip_high FROM trips_raw) SELECT {s} FROM t"))
def q_h9(spark, sf_dir):
    """H9: log1p, exp and clipping on both sides or one, missing values kept."""
    km = F.col(_KM)
    return TR.load_trips(spark, sf_dir).select(
        "BookingID", F.log1p(km).alias("log1p_km"), F.exp(-km / 1000).alias("exp_km"), E.clip(km, 200, 500).alias("clip_km"),
        E.clip(km, lo=200).alias("clip_low"), E.clip(km, hi=500).alias("clip_high"))


H10 = [BK] + [(f"{k}{n}", "d") for k in ("py", "np") for n in (0, 1, 2, 3)]


@register("H10_rounding", H10, lambda s: (
    "WITH t AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) "
    "AS BookingID, l_extendedprice * l_discount / 8 AS x FROM lineitem), r AS (SELECT BookingID, "
    + ", ".join(f"{O.pyr('x', n)} AS py{n}, round_even(x * {O.d(10 ** n)}, 0) / {O.d(10 ** n)} AS np{n}"
                for n in (0, 1, 2, 3)) + f" FROM t) SELECT {s} FROM r"))
def q_h10(spark, sf_dir):
    """Half-even rounding of exact values (as Python) and of scaled values (as numpy), 0 to 3 digits."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                              F.date_format("l_shipdate", "yyyyMMdd")).alias("BookingID"),
                  (F.col("l_extendedprice") * F.col("l_discount") / 8).alias("x"))
    return x.select("BookingID", *[f("x", n).alias(f"{k}{n}") for k, f in (("py", E.py_round), ("np", E.round_even))
                                   for n in (0, 1, 2, 3)])


# stand-in model output for the stacked targets: a given probability column derived from the booking id
P_STANDIN = "CAST(CAST(split_part(BookingID, '-', 1) AS BIGINT) % 101 AS DOUBLE) / CAST(100 AS DOUBLE)"


def _with_p(df: DataFrame) -> DataFrame:
    okey = F.split(F.col("BookingID"), "-").getItem(0).cast("long")
    return df.withColumn("predicted_delay_prob", (okey % 101).cast("double") / F.lit(100.0))


def _target_sql(p_sql, weights):
    t = (f"{O.d(weights[0])} * efficiency_score + {O.d(0.20)} * lane_popularity + {O.d(0.15)} * ({O.d(1)} - risk_score)"
         f" + {O.d(0.15)} * ({O.d(1)} - {p_sql}) + {O.d(0.10)} * ({O.d(1)} - driver_delay_rate)")
    if weights[1]:
        t = (f"({t}) + {O.gmin(O.d(0.05), f'lane_maturity * {O.d(0.004)}')}"
             f" + CASE WHEN is_peak_month <> 0 THEN {O.d(0.02)} ELSE {O.d(0)} END"
             f" + CASE WHEN distance_category = 0 THEN {O.d(0.02)} WHEN distance_category = 2 THEN {O.d(-0.02)} ELSE {O.d(0)} END")
    return f"round_even({O.clip01(t)}, 4)"


@register("I20_elite_target_81", [BK, ("probabilistic_efficiency", "d")], lambda s: _from_features(
    s, src=f"(SELECT *, {_target_sql(P_STANDIN, (0.35, True))} AS probabilistic_efficiency FROM features)"))
def q_i20(spark, sf_dir):
    """Stacked 8.1 target from features and a given delay-probability column."""
    return SC.elite_target_81(_with_p(_feat(spark, sf_dir).export()))


@register("I21_elite_target_80", [BK, ("probabilistic_efficiency", "d")], lambda s: _from_features(
    s, src=f"(SELECT *, {_target_sql(P_STANDIN, (0.40, False))} AS probabilistic_efficiency FROM features)"))
def q_i21(spark, sf_dir):
    """Stacked 8.0 target from features and a given delay-probability column."""
    return SC.elite_target_80(_with_p(_feat(spark, sf_dir).export()))


D12 = [("mean", "d"), ("std", "d"), ("min", "d"), ("max", "d")]


@register("D12_target_stats", D12, lambda s: _from_features(
    s, src=f"(SELECT avg(t) AS mean, stddev_samp(t) AS std, min(t) AS min, max(t) AS max FROM "
           f"(SELECT {_target_sql(P_STANDIN, (0.35, True))} AS t FROM features))"))
def q_d12(spark, sf_dir):
    """Mean, sample std, min and max of the stacked 8.1 target."""
    t = SC.elite_target_81(_with_p(_feat(spark, sf_dir).export()))
    return AG.target_stats(t, "probabilistic_efficiency")
