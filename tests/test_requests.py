import random

from lanecast.operators import lanes as L
from lanecast.operators import requests as R
from lanecast.sources.requests import REQUEST_SCHEMA


def _req(spark, rows):
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def base(**kw):
    r = dict(request_id="1", origin="Delhi", destination="Mumbai", trip_date="2026-05-01", weight_tonnes=5.0,
             vehicle_type=None, competitor_price=None, diesel_price=None, addons=None, origin_lat=None,
             origin_lon=None, dest_lat=None, dest_lon=None)
    r.update(kw)
    return tuple(r[f.name] for f in REQUEST_SCHEMA.fields)


def test_validation_reasons(spark):
    rows = [base(request_id="ok"), base(request_id="w0", weight_tonnes=0.0), base(request_id="w51", weight_tonnes=51.0),
            base(request_id="d", trip_date="2026-02-30"), base(request_id="d2", trip_date="01-05-2026"),
            base(request_id="o", origin="D"), base(request_id="b", origin="   "),
            base(request_id="c", competitor_price=0.0), base(request_id="dp", diesel_price=250.0),
            base(request_id="lat", origin_lat=91.0), base(request_id="nl", trip_date="2026-05-01\n"), base(request_id="d1", trip_date="2026-5-1")]
    valid, rejected = R.validate_requests(_req(spark, rows))
    assert sorted(r.request_id for r in valid.collect()) == ["d1", "ok"]
    errs = {r.request_id: r.error for r in rejected.collect()}
    assert "weight_tonnes: Input should be greater than 0" in errs["w0"]
    assert "less than or equal to 50" in errs["w51"]
    assert "YYYY-MM-DD" in errs["nl"]
    assert "YYYY-MM-DD" in errs["d"] and "YYYY-MM-DD" in errs["d2"]
    assert "at least 2 characters" in errs["o"]
    assert "origin: blank" in errs["b"]
    assert errs["c"].startswith("Validation error: competitor_price")


def test_normalize(spark):
    rows = [base(request_id="a", origin="  Pune ", vehicle_type=" mcv ", diesel_price=0.0,
                 addons=["extra_rope", "bogus", "extra_rope"]),
            base(request_id="b", vehicle_type="truck", diesel_price=95.5), base(request_id="c", vehicle_type="")]
    out = {r.request_id: r for r in R.normalize_requests(_req(spark, rows)).collect()}
    assert out["a"].origin == "Pune" and out["a"].vehicle_type == "MCV"
    assert out["a"].diesel_price == 87.67 and out["a"].diesel_source == "default"
    assert out["a"].addons == ["extra_rope", "extra_rope"]
    assert out["b"].vehicle_type == "FTL" and out["b"].diesel_source == "vision"
    assert out["c"].vehicle_type == "FTL" and out["c"].addons == []


def test_clamp_weight(spark):
    rows = [base(request_id="a", vehicle_type="LCV", weight_tonnes=4.0), base(request_id="b", vehicle_type="LCV",
                                                                                weight_tonnes=3.0)]
    out = {r.request_id: r.weight_tonnes for r in R.clamp_weight(R.normalize_requests(_req(spark, rows))).collect()}
    assert out == {"a": 1.5, "b": 3.0}


KB_SCHEMA = ("ok string, dk string, lane_popularity double, route_risk double, driver_delay_rate double, "
             "trip_count long, avg_dist_km double")


def _global(spark):
    return L.lane_kb_global(spark.createDataFrame([(0.3, 0.2, 0.1, 50.0)], "lane_popularity double, route_risk double, "
                                                  "driver_delay_rate double, TRANSPORTATION_DISTANCE_IN_KM double"))


def test_lookup_lane_exact_contains_global(spark):
    kb = spark.createDataFrame([("asia", "europe", 0.5, 0.1, 0.2, 10, 100.0), ("asia", "africa", 0.4, 0.1, 0.2, 5, 0.0),
                                ("east asia", "eur", 0.9, 0.1, 0.2, 7, 300.0)], KB_SCHEMA)
    req = spark.createDataFrame([("1", " ASIA ", "Europe"), ("2", "asi", "EUR"), ("3", "Nowhere", "x"),
                                 ("4", "east", "eu"), ("5", None, "eur")],
                                "request_id string, origin string, destination string")
    out = {r.request_id: (r.lane_match, r.trip_count, r.lane_popularity)
           for r in L.lookup_lane(req, kb, _global(spark)).collect()}
    # 'asi'/'eur' is contained in (asia, europe) and (east asia, eur): key order picks (asia, europe)
    assert out == {"1": ("exact", 10, 0.5), "2": ("contains", 10, 0.5), "3": ("global", 0, 0.3),
                   "4": ("contains", 7, 0.9), "5": ("global", 0, 0.3)}


def test_contains_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abİß 中", k=n))
    lanes = sorted({(word(rng.randrange(1, 9)).lower().strip(), word(rng.randrange(1, 9)).lower().strip())
                    for _ in range(300)} | {("x" * 200 + "q" + "y" * 40, "z" * 150), ("i̇" * 130, "b")})
    kb = spark.createDataFrame([(a, b, float(i), 0.1, 0.2, i, 1.0) for i, (a, b) in enumerate(lanes)], KB_SCHEMA)
    names = [("", "a"), ("a", ""), ("a", "b"), ("ab", "a"), ("x" * 125, "z" * 125), ("x" * 3 + "qy", "z"),
             ("İ" * 119, "b"), ("zzz", "a"), ("中", "ß"), ("a", "zz")]
    names += [(a[i:i + n], b[j:j + n]) for a, b in lanes[::7] for i, j, n in ((0, 1, 2), (1, 0, 3), (0, 0, 5))]
    req = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(names)],
                                "request_id string, origin string, destination string")
    got = {r.request_id: (r.lane_match, r.trip_count) for r in L.lookup_lane(req, kb, _global(spark)).collect()}
    for i, (a, b) in enumerate(names):
        a, b = a.strip().lower(), b.strip().lower()
        hits = [k for k, (x, y) in enumerate(lanes) if a and b and a in x and b in y]
        want = (("exact", lanes.index((a, b))) if (a, b) in lanes and a and b else
                ("contains", hits[0]) if hits else ("global", 0))
        if (a, b) in lanes and not (a and b):
            want = ("exact", lanes.index((a, b)))
        assert got[str(i)] == want, (a, b)


def test_lookup_plan_has_no_nested_loop_and_runs_no_job(spark):
    kb = spark.createDataFrame([("asia", "europe", 0.5, 0.1, 0.2, 10, 100.0)], KB_SCHEMA)
    req = spark.createDataFrame([("1", "asi", "eur")], "request_id string, origin string, destination string")
    index = L.stored_index(kb, _global(spark))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = L.lookup_lane(req, index)._jdf.queryExecution().toString()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_without_any_trip_uses_constants(spark):
    kb = spark.createDataFrame([], KB_SCHEMA)
    g = L.lane_kb_global(spark.createDataFrame([], "lane_popularity double, route_risk double, driver_delay_rate double, "
                                                   "TRANSPORTATION_DISTANCE_IN_KM double"))
    req = spark.createDataFrame([("1", "asi", "eur")], "request_id string, origin string, destination string")
    r = L.lookup_lane(req, kb, g).first()
    assert (r.lane_match, r.lane_popularity, r.avg_dist_km, r.trip_count) == ("global", 0.35, 500.0, 0)
