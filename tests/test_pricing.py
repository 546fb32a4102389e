"""Golden quotes G1-G4 (FIXTURES.md section 3) and pricing properties."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanecast.operators import pricing as P
from lanecast.plans import quote as Q

SCHEMA = ("request_id string, trip_day date, distance_km double, distance_method string, weight_tonnes double, "
          "vehicle_type string, competitor_price double, diesel_price double, addons array<string>, "
          "lane_popularity double, route_risk double, driver_delay_rate double, trip_count long, "
          "delay_probability double, efficiency_score double")

GOLDEN = [
    ("G1", dt.date(2026, 5, 1), 1515.5, "haversine", 12.5, "FTL", None, 87.67, ["helper_required", "express_delivery"],
     0.35, 0.3, 0.2, 0, 0.23, 0.81),
    ("G2", dt.date(2026, 11, 10), 201.8, "haversine", 10.0, "FTL", 40000.0, 87.67, [], 0.80, 0.3, 0.2, 0, 0.50, 0.40),
    ("G3", dt.date(2026, 7, 4), 100.0, "historical_avg", 2.0, "LCV", 3000.0, 90.0, ["extra_rope", "extra_rope"],
     0.0, 0.3, 0.2, 10, 0.0, 1.0),
    ("G4", dt.date(2026, 1, 5), 2000.0, "historical_avg", 20.0, "CARTING", None, 200.0, [], 1.0, 0.3, 0.2, 10, 0.0, 1.0),
]

# request -> (m_loaded, m_empty, arrival, T_active 1dp, p_return 4dp, c_base, c_risk, p_min, p_max, floor, ceiling,
#             c_survival, feasible, recommended, status, addon total, final)
EXPECTED = {
    "G1": (4.25, 5.0, "12:18, Sat", 12.3, 0.5959, 47380.92, 10738.34, 58014.65, 66716.85, 58014.65, 66716.85,
           37475.64, True, 58014.65, "Healthy", 18604, 76619),
    "G2": (3.9, 4.7, "10:02, Tue", 8.0, 0.7804, 10583.49, 826.77, 12072.06, 13882.87, 36000.0, 36000.0,
           5363.74, True, 36000.0, "Healthy", 0, 36000),
    "G3": (14.8, 19.7, "08:00, Sat", 18.0, 0.1225, 2426.44, 400.91, 2714.26, 3121.40, 2714.26, 3121.40,
           794.77, True, 2714.26, "Healthy", 300, 3014),
    "G4": (4.5, 6.5, None, 0.0, 0.99, 94355.56, 615.38, 91172.10, 104847.91, 91172.10, 104847.91,
           91755.56, False, 91755.56, "Low Margin", 0, 91756),
}


@pytest.fixture(scope="module")
def priced(spark):
    df = P.add_temporal(spark.createDataFrame(GOLDEN, SCHEMA))
    return {r.request_id: r for r in Q.price(df).collect()}


@pytest.mark.parametrize("gid", list(EXPECTED))
def test_golden_quote(priced, gid):
    r = priced[gid]
    e = EXPECTED[gid]
    r2 = lambda x: round(x, 2)
    assert (r.m_loaded, r.m_empty) == (e[0], e[1])
    if e[2]:
        assert r.p_return_model.arrival_time == e[2]
    else:
        assert r.p_return_model.arrival_time.startswith("22:00")
    assert r.p_return_model.T_active_h == e[3]
    assert round(r.p_return, 4) == e[4]
    assert (r2(r.c_base), r2(r.c_risk)) == (e[5], e[6])
    assert (r.p_min, r.p_max) == (e[7], e[8])
    assert (r2(r.floor), r2(r.ceiling)) == (e[9], e[10])
    assert r2(r.c_survival) == e[11]
    assert r.is_feasible is e[12]
    assert r.recommended_price == e[13]
    assert r.status == e[14]
    assert (r.addon_total, r.final_price) == (e[15], e[16])


def test_g3_breakdown_has_one_entry(priced):
    assert dict(priced["G3"].addon_breakdown) == {"extra_rope": ("Extra Rope", 150)}


def test_corridor_properties(priced):
    for r in priced.values():
        assert r.p_min <= r.p_max
        assert r.floor <= r.ceiling
        assert r.recommended >= r.c_survival - 1e-9


def test_golden_distances_from_gazetteer(spark):
    df = spark.createDataFrame([("G1", "Delhi", "Mumbai", 0.0), ("G2", " delhi ", "ROORKEE", 0.0),
                                ("X", "Nowhere", "Delhi", 321.44), ("Y", "Nowhere", "Delhi", None)],
                               "request_id string, origin string, destination string, avg_dist_km double")
    for c in ("origin_lat", "origin_lon", "dest_lat", "dest_lon"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    out = {r.request_id: (r.distance_km, r.distance_method) for r in P.add_distance(df, spark).collect()}
    assert out == {"G1": (1515.5, "haversine"), "G2": (201.8, "haversine"), "X": (321.4, "historical_avg"),
                   "Y": (500.0, "default_fallback")}


def test_road_table_takes_precedence(spark):
    df = spark.createDataFrame([("R", "Delhi", "Mumbai", 10.0, 1.0, 2.0, 3.0, 4.0),
                                ("Z", "Delhi", "Mumbai", 10.0, 1.0, 2.0, 9.0, 9.0)],
                               "request_id string, origin string, destination string, avg_dist_km double, "
                               "origin_lat double, origin_lon double, dest_lat double, dest_lon double")
    road = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 1400.04), (9.0, 9.0, 9.0, 9.0, 0.0),
                                  (28.6139, 77.2090, 19.0760, 72.8777, 1420.0)],
                                 "lat1 double, lon1 double, lat2 double, lon2 double, km double")
    out = {r.request_id: (r.distance_km, r.distance_method) for r in P.add_distance(df, spark, road).collect()}
    # a zero road distance counts as missing, so Z falls through to the gazetteer pair
    assert out == {"R": (1400.0, "osrm"), "Z": (1420.0, "osrm")}


def test_road_joins_shuffle_rows_with_coordinates_only(spark):
    """A request is shuffled for its own coordinates at most; the gazetteer's pairs of the road table are broadcast."""
    xy = "origin_lat double, origin_lon double, dest_lat double, dest_lon double"
    rows = [("own", "Delhi", "Mumbai", 10.0, 1.0, 2.0, 3.0, 4.0), ("own", "Delhi", "Mumbai", 10.0, 1.0, 2.0, 3.0, 4.0),
            (None, "Delhi", "Mumbai", 10.0, None, 2.0, 3.0, 4.0), ("far", "Nowhere", "Delhi", 10.0, 5.0, 5.0, 5.0, None),
            ("nan", "Pune", "Delhi", 10.0, float("nan"), 2.0, 3.0, 4.0), ("x", "Delhi", "Mumbai", 10.0, 0.0, -0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, f"request_id string, origin string, destination string, avg_dist_km double, {xy}")
    road = spark.createDataFrame([(1.00004, 2.0, 3.0, 4.0, 50.0), (1.0, 2.0, 3.0, 4.0, 40.0), (1.0, 2.0, 3.0, 4.0, None),
                                  (28.6139, 77.2090, 19.0760, 72.8777, 1420.0), (0.0, 0.0, 0.0, 0.0, 7.0),
                                  (float("nan"), 2.0, 3.0, 4.0, 9.0), (None, 2.0, 3.0, 4.0, 3.0)],
                                 "lat1 double, lon1 double, lat2 double, lon2 double, km double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.add_distance(df, spark, road)
        got = [(r.request_id, r.req_road_km, r.gaz_road_km) for r in out.collect()]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got, key=str) == sorted([("own", 40.0, 1420.0), ("own", 40.0, 1420.0), (None, None, 1420.0), ("far", None, None),
                                           ("nan", 9.0, None), ("x", 7.0, 1420.0)], key=str)
    joins = [line for line in plan.splitlines() if "Join " in line]
    plain = [line for line in joins if "broadcast" not in line]
    assert len(plain) == 1 and "_req0" in plain[0]
    below = plan[plan.index(plain[0]):]
    assert "isnotnull(origin_lat" in below[:below.index("Aggregate")]


def test_quote_document_contract(spark):
    """The nested quote document keeps the service's response layout (field names and nesting)."""
    df = P.add_temporal(spark.createDataFrame(GOLDEN, SCHEMA))
    df = df.withColumn("origin", F.lit("Delhi")).withColumn("destination", F.lit("Mumbai")) \
        .withColumn("diesel_source", F.lit("default"))
    schema = Q.quote_document(Q.price(df)).schema

    def names(st):
        return [f.name for f in st.fields]

    assert names(schema) == ["request_id", "origin", "destination", "trip_date", "weight_tonnes", "vehicle_type",
                             "abstraction", "efficiency_score", "efficiency_label", "delay_probability", "p_return",
                             "p_return_model", "confidence_score", "confidence_label", "pricing", "addons",
                             "final_price", "status"]
    assert names(schema["abstraction"].dataType) == [
        "distance_km", "distance_method", "day_name", "season", "is_peak_season", "m_loaded_kmpl", "m_empty_kmpl",
        "lane_popularity", "route_risk", "lane_trip_count", "vehicle_type", "diesel_price", "diesel_source"]
    assert names(schema["p_return_model"].dataType) == [
        "arrival_time", "expected_dwell_h", "T_active_h", "T_grace_h", "lambda", "vehicle_type", "within_grace"]
    pricing = schema["pricing"].dataType
    assert names(pricing) == ["operational", "risk", "corridor", "feasibility", "recommended_price", "status"]
    assert names(pricing["operational"].dataType) == [
        "fuel_loaded_L", "fuel_empty_L", "fuel_loaded_cost", "fuel_empty_cost", "tolls_roundtrip", "driver_wage",
        "maintenance", "mobilization", "c_base", "m_loaded_kmpl", "m_empty_kmpl", "diesel_price"]
    assert names(pricing["risk"].dataType) == ["p_return", "p_no_return", "empty_fuel_val", "c_risk"]
    assert names(pricing["corridor"].dataType) == [
        "p_min", "p_max", "premium", "floor", "ceiling", "was_snapped", "competitor_price", "epsilon_high_pct",
        "epsilon_low_pct", "ml_multiplier", "ml_delay_prem_pct", "ml_eff_adj_pct"]
    assert names(pricing["feasibility"].dataType) == ["c_survival", "is_feasible", "recommended", "status", "note"]
    assert names(schema["addons"].dataType) == ["selected", "breakdown", "total"]
    assert schema["final_price"].dataType.typeName() == "long"


def test_quotes_are_stored_before_what_follows_from_a_row(spark, monkeypatch):
    """The quote queries store the joined requests only; each prices them for its own columns, without another join."""
    from lanecast.plans import cache
    from lanecast.plans import quote_queries as QQ
    stored = {}
    stage = QQ.stage_table
    monkeypatch.setattr(QQ, "stage_table", lambda df, name: stored.update({name: df}) or stage(df, name))
    monkeypatch.setattr(cache, "_MEMO", {})
    quotes = QQ._quotes(spark, "/root/testdata/sf0.001")
    assert {"requests", "valid-requests", "located-requests"} == set(stored)
    located = stored["located-requests"].columns
    assert {"lane_match", "trip_count", "distance_km", "distance_method"} < set(located)
    assert not {"month", "p_return", "floor", "addon_breakdown", "final_price"} & set(located)
    assert {"month", "p_return", "floor", "addon_breakdown", "final_price"} < set(quotes.columns)
    plan = quotes.select("request_id", "p_min")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "addons" not in plan
    checked = stored["located-requests"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Field required" not in checked              # the rules of B4 run once, for the stored valid requests
    assert quotes.count() == stored["valid-requests"].count() == quotes.select("request_id").distinct().count()
