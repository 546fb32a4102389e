"""Feature pipeline: edge rows, null keys, properties (past-only, scaling range, order independence)."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lanecast.plans.features import PROFILE_81, build_features
from lanecast.sources.trips import coerce_timestamps

COLS = ("BookingID string, vehicle_no string, Origin_Location string, Destination_Location string, "
        "TRANSPORTATION_DISTANCE_IN_KM double, trip_start_date string, trip_end_date string, "
        "Planned_ETA string, actual_eta string, `Market/Regular` string")


def _trips(spark, rows):
    return coerce_timestamps(spark.createDataFrame(rows, COLS))


def _row(i, veh, o, d, km, start_h, delay_h=0, mr="Market"):
    base = dt.datetime(2024, 1, 1)
    s = base + dt.timedelta(hours=start_h) if start_h is not None else None
    e = s + dt.timedelta(hours=5) if s else None
    fmt = lambda t: t.strftime("%Y-%m-%d %H:%M:%S") if t else None
    a = e + dt.timedelta(hours=delay_h) if e else None
    return (f"B{i:03d}", veh, o, d, km, fmt(s), fmt(e), fmt(e), fmt(a), mr)


@pytest.fixture(scope="module")
def small(spark):
    rows = []
    lanes = [("A, North, India", "B, South, India"), ("B, South, India", "A, North, India"), ("C, East, India", "D, West, India")]
    i = 0
    for v in range(6):
        for k in range(8):
            o, d = lanes[(v + k) % 3]
            rows.append(_row(i, f"V{v}", o, d, 100.0 + 37 * i % 700, v * 3 + k * 30, delay_h=(i * 7) % 11,
                             mr="Regular " if i % 2 else None))
            i += 1
    rows.append(_row(i, None, "A, North, India", "B, South, India", 250.0, 10, 3))          # NULL vehicle
    rows.append(_row(i + 1, "V0", None, "B, South, India", None, 17, 1))                  # NULL origin, NULL km
    rows.append(_row(i + 2, "V1", "A, North, India", "B, South, India", 80.0, None, 0))   # NULL start
    rows.append(_row(i + 3, "V9", "Solo, India", "Other, India", 600.0, 40, 9))           # single-trip vehicle
    return rows


def test_null_key_semantics(spark, small):
    b = build_features(_trips(spark, small))
    f = {r.BookingID: r for r in b.frame.collect()}
    nv = f[small[-4][0]]
    assert nv.next_origin is None and nv.driver_delay_rate == pytest.approx(b.scalars["flag_mean"])
    no = f[small[-3][0]]
    assert no.route_count is None and no.route_risk_raw == 0.0 and no.lane_popularity_raw is None
    assert no.TRANSPORTATION_DISTANCE_IN_KM == pytest.approx(b.scalars["distance_median"])
    single = f[small[-1][0]]
    assert single.next_origin is None and single.dwell_time_hrs == 0.0 and single.route_count == 0


def test_driver_rate_is_past_only(spark, small):
    b1 = build_features(_trips(spark, small)).frame
    changed = [r if r[1] != "V2" or r[0] < "B020" else r[:8] + (None,) + r[9:] for r in small]
    b2 = build_features(_trips(spark, changed)).frame
    a = {r.BookingID: r.driver_delay_rate for r in b1.where(F.col("vehicle_no") == "V2").collect()}
    c = {r.BookingID: r.driver_delay_rate for r in b2.where(F.col("vehicle_no") == "V2").collect()}
    first_changed = min(k for k in a if k >= "B020")
    for k in a:
        if k <= first_changed:
            assert a[k] == c[k], k


def test_scaled_train_columns_in_unit_range(spark, small):
    b = build_features(_trips(spark, small))
    for r in b.frame.where("is_train").collect():
        for c in ("lane_popularity", "cost_weight", "idle_loss", "route_risk", "risk_score"):
            v = getattr(r, c)
            assert v is None or -1e-12 <= v <= 1 + 1e-12


def test_independent_of_input_order_and_chunks(spark, small):
    a = build_features(_trips(spark, small)).export()
    b = build_features(_trips(spark, list(reversed(small))).repartition(5), hot_rows=2, rows_per_chunk=3).export()
    c = build_features(_trips(spark, small)).export()
    ra, rb, rc = (sorted(x.collect()) for x in (a, b, c))
    assert ra == rb == rc
    assert len(ra) == len(small)


def test_equal_tercile_edges_raise(spark):
    # every trip alone on its own lane with the same inputs: all scores equal, so the edges coincide
    rows = [_row(i, f"V{i}", f"A{i}, N, India", f"B{i}, S, India", 100.0, 0, 0) for i in range(5)]
    with pytest.raises(ValueError, match="unique"):
        build_features(_trips(spark, rows))


def test_profile_725_exports_its_columns(spark, small):
    from lanecast.plans.features import PROFILE_725
    b = build_features(_trips(spark, small), PROFILE_725)
    cols = b.export().columns
    assert "cost_weight" not in cols and "is_market" not in cols and cols[-1] == "Market/Regular"
    assert PROFILE_81.export[-1] == "is_market"


def test_popularity_log_stays_finite_past_overflow(spark):
    from lanecast.operators.lanes import add_lane_features
    df = spark.createDataFrame([(40000, 39999, 0, 100.0), (10, 10, 0, 100.0)],
                               "route_count long, lane_prior_bookings long, lane_prior_flags long, est_fuel_cost double")
    out = add_lane_features(df).collect()
    big, small = out[0], out[1]
    assert big.lane_popularity_raw == float("inf")
    assert big.lane_popularity_log == pytest.approx(0.02 * 40000 + math.log(39999), rel=1e-12)
    assert small.lane_popularity_log == pytest.approx(math.log1p(10 * math.exp(0.2) + 1), rel=1e-12)


def test_time_split_order(spark, small):
    from dataclasses import replace
    from lanecast.plans.features import PROFILE_81
    b = build_features(_trips(spark, small), replace(PROFILE_81, split_order="time"))
    rows = b.frame.select("trip_start_date", "BookingID", "vehicle_no", "is_train").collect()
    key = lambda r: (r.trip_start_date is None, r.trip_start_date or 0, r.vehicle_no is None, r.vehicle_no or "", r.BookingID)
    ordered = sorted(rows, key=key)
    cut = int(len(rows) * 0.8)
    assert [r.is_train for r in ordered] == [True] * cut + [False] * (len(rows) - cut)


def test_many_small_chunks_equal_plain_windows(spark, small):
    a = build_features(_trips(spark, small), hot_rows=3, rows_per_chunk=7).frame    # keys span chunks
    b = build_features(_trips(spark, small)).frame
    cols = ["BookingID", "next_origin", "next_start_time", "driver_delay_rate", "route_count", "lane_prior_bookings",
            "route_risk_raw", "sort_position", "is_train", "efficiency_score"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())


def test_scans_carry_no_column_that_follows_from_the_row(spark, monkeypatch):
    """Neither the shuffles nor the stored scan hold derived columns or the key beside its columns."""
    from lanecast.plans import features as FT
    from lanecast.sources.trips import load_trips
    stored = []
    stage = FT.stage_table
    monkeypatch.setattr(FT, "stage_table", lambda df, name: stored.append((name, df)) or stage(df, name))
    df, _ = FT.prepare(FT.stage_table(load_trips(spark, "/root/testdata/sf0.001"), "trips"))
    out = FT.scans(df)
    (name, scanned), = [x for x in stored if x[0] != "trips"]
    assert name == "scanned-trips" and not set(FT.V.ROW_FEATURES) & set(scanned.columns)
    assert set(FT.V.ROW_FEATURES) < set(out.columns) and "lane_maturity" in out.columns and "idle_loss_raw" in out.columns


def test_place_names_are_not_shuffled_with_the_line_items(spark):
    """The names join last, by broadcast: no exchange of the trips view holds a concatenated place."""
    from lanecast.sources.trips import trips_view
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trips_view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    at = max(i for i, line in enumerate(plan.splitlines()) if "BroadcastHashJoin" in line)
    assert not any("BroadcastHashJoin" in x for x in plan[plan.index("Exchange hashpartitioning"):].splitlines())
    assert at < min(i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line)


def test_both_scans_share_one_shuffle_of_the_trips(spark, small, monkeypatch):
    """The stored scan has one exchange of whole trips, also where lanes and vehicles are split, and no join moves them."""
    from lanecast.plans import features as FT
    stored = {}
    stage = FT.stage_table
    monkeypatch.setattr(FT, "stage_table", lambda df, name: stored.update({name: df}) or stage(df, name))
    build_features(_trips(spark, small), hot_rows=3, rows_per_chunk=7)
    plan = stored["scanned-trips"]._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert "_range" in lines[at[0]] and "REPARTITION_BY_COL" in lines[at[0]]
    # the others are the totals by (range, lane), below that one
    assert not any("vehicle_no" in lines[i] or "BookingID" in lines[i] for i in at)
    assert sum("Window" in x for x in lines[:at[0]]) >= 3


def test_lane_names_are_keyed_once_a_lane(spark):
    """The trips are summed up by their names before a name is cut into its key; means skip NULL."""
    from lanecast.operators.lanes import lane_kb
    rows = [("A, North, India", "B, South", 1.0, 2.0, 0.5, 10.0), (" x, north , India", "C,south", 3.0, None, 0.5, 30.0),
            ("A, North, India", "B, South", 5.0, None, 1.0, None), (None, "B, South", None, None, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "Origin_Location string, Destination_Location string, lane_popularity double, "
                                     "route_risk double, driver_delay_rate double, TRANSPORTATION_DISTANCE_IN_KM double")
    kb = lane_kb(df)
    assert sorted(map(tuple, kb.collect())) == [("nan", "south", None, None, 0.0, 1, 5.0),
                                                ("north", "south", 3.0, 2.0, 2 / 3, 3, 20.0)]
    plan = kb._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan[plan.rindex("HashAggregate"):]


def test_lane_means_do_not_depend_on_the_order_of_the_trips(spark):
    import random
    from lanecast.operators.lanes import lane_kb
    rnd = random.Random(2)
    km = [rnd.randrange(1, 10_000_000) / 10_000 for _ in range(3000)]
    want = {f"o{k}": math.fsum(km[k::7]) / len(km[k::7]) for k in range(7)}
    for order in (list(range(3000)), rnd.sample(range(3000), 3000)):
        df = spark.createDataFrame([(f"x, o{i % 7}", "x, d", km[i], None, float("inf"), km[i]) for i in order],
                                   "Origin_Location string, Destination_Location string, lane_popularity double, "
                                   "route_risk double, driver_delay_rate double, TRANSPORTATION_DISTANCE_IN_KM double")
        got = lane_kb(df.repartition(11)).collect()
        assert {r.ok: r.avg_dist_km for r in got} == want == {r.ok: r.lane_popularity for r in got}
        assert all(r.route_risk is None and r.driver_delay_rate == float("inf") for r in got)
