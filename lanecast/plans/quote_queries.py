"""Registered queries over the requests view: validation, lookup, distance, pricing, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast import oracle as O
from lanecast.functions import expr as E
from lanecast.operators import lanes as L
from lanecast.operators import pricing as P
from lanecast.operators import requests as R
from lanecast.operators.lane_index import stored_index
from lanecast.plans import quote as Q
from lanecast.plans.cache import memo
from lanecast.plans.feature_queries import _feat
from lanecast.registry import register
from lanecast.session import materialize, stage_table
from lanecast.sources.dims import vehicle_attr
from lanecast.sources.requests import requests_view, road_view, scan_requests, write_quotes
from lanecast.streaming.quotes import scratch_dir

QSQL = O.quotes_sql()
RID = ("request_id", "s")


def _kb(spark: SparkSession, sf_dir: str):
    def build():
        feats = _feat(spark, sf_dir).export()
        return materialize(L.lane_kb(feats)), materialize(L.lane_kb_global(feats))
    return memo(spark, ("kb", sf_dir), build)


def _index(spark: SparkSession, sf_dir: str):
    """The stored lane index, which batch and stream share."""
    return memo(spark, ("lane-index", sf_dir), lambda: stored_index(*_kb(spark, sf_dir)))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, stored once: the lane lookup reads them for the distinct pairs and for the join back."""
    return memo(spark, ("requests", sf_dir), lambda: stage_table(requests_view(spark, sf_dir), "requests"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced requests: joined and stored once; each query prices them for the columns that it shows."""
    def build():
        return Q.quote_requests(_requests(spark, sf_dir), _index(spark, sf_dir), None, Q.given_scores(),
                                road_view(spark, sf_dir), store=stage_table)[0]
    return memo(spark, ("quotes", sf_dir), build)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    req, _ = Q.prepare_requests(_requests(spark, sf_dir), _index(spark, sf_dir), None, road_view(spark, sf_dir))
    return req


def _qsql(where: str = "", src: str = "quotes2"):
    return lambda s: f"WITH {QSQL} SELECT {s} FROM {src} {where}"


def _quote_query(key: str, cols: list[tuple[str, str]], doc: str, src: str = "quotes2", where: str = ""):
    def fn(spark, sf_dir):
        return _quotes(spark, sf_dir)
    fn.__doc__ = doc
    register(key, [RID] + cols, _qsql(where, src))(fn)


# --- B ----------------------------------------------------------------------------------------

@register("B4_validate_requests", [RID, ("is_valid", "b"), ("error", "s")], lambda s: (
    f"WITH {O.requests_sql()}, c AS (SELECT request_id, len({O.reasons_sql()}) = 0 AS is_valid, "
    f"CASE WHEN len({O.reasons_sql()}) > 0 THEN 'Validation error: ' || array_to_string({O.reasons_sql()}, '; ') END "
    f"AS error FROM req_raw) SELECT {s} FROM c"))
def q_b4(spark, sf_dir):
    """Field rules; rejected requests carry the reasons joined by '; '."""
    valid, rejected = R.validate_requests(requests_view(spark, sf_dir))
    return (valid.select("request_id", F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("error"))
            .unionByName(rejected.select("request_id", F.lit(False).alias("is_valid"), "error")))


B5 = [RID, ("origin", "s"), ("destination", "s"), ("vehicle_type", "s"), ("diesel_price", "d"),
      ("diesel_source", "s"), ("addon_list", "s")]


@register("B5_normalize_requests", B5, lambda s: (
    f"WITH {QSQL}, b AS (SELECT *, array_to_string(addons, ',') AS addon_list FROM q_valid) SELECT {s} FROM b"))
def q_b5(spark, sf_dir):
    """Trimmed places, known vehicle class, diesel default, known add-ons in order."""
    valid, _ = R.validate_requests(requests_view(spark, sf_dir))
    return R.normalize_requests(valid).withColumn("addon_list", F.array_join("addons", ","))


@register("B6_clamp_weight", [RID, ("vehicle_type", "s"), ("weight_tonnes", "d")], lambda s: (
    f"WITH {QSQL}, b AS (SELECT request_id, vehicle_type, CASE "
    + " ".join(f"WHEN vehicle_type = '{k}' AND weight_tonnes > {O.d(m)} THEN {O.d(dft)}"
               for k, (m, dft) in O.V.weight_limits.items())
    + f" ELSE weight_tonnes END AS weight_tonnes FROM q_valid) SELECT {s} FROM b"))
def q_b6(spark, sf_dir):
    """Weight above the class maximum replaced by the class default (UI rule, opt-in)."""
    valid, _ = R.validate_requests(requests_view(spark, sf_dir))
    return R.clamp_weight(R.normalize_requests(valid))


# --- C ------------------------------------------------------------------------------------------

LANE = [("lane_match", "s"), ("lane_popularity", "d"), ("route_risk", "d"), ("driver_delay_rate", "d"),
        ("trip_count", "i"), ("avg_dist_km", "d")]


@register("C1_lane_exact", [RID] + LANE, _qsql("WHERE lane_match = 'exact'", "q_lane"))
def q_c1(spark, sf_dir):
    """Requests whose (origin, destination) key is a KB lane (equi-join with the stored lanes)."""
    return _prepared(spark, sf_dir).where(F.col("lane_match") == "exact")


@register("C2_lane_contains", [RID] + LANE, _qsql("WHERE lane_match = 'contains'", "q_lane"))
def q_c2(spark, sf_dir):
    """Misses resolved to the first KB lane (key order) whose keys contain both names."""
    return _prepared(spark, sf_dir).where(F.col("lane_match") == "contains")


@register("C3_lane_global_fallback", [RID] + LANE, _qsql("", "q_lane"))
def q_c3(spark, sf_dir):
    """Final lane context of every valid request (exact, contains, else global averages)."""
    return _prepared(spark, sf_dir)


GAZ = [("o_city_lat", "d"), ("o_city_lon", "d"), ("d_city_lat", "d"), ("d_city_lon", "d")]


@register("C4_city_coords_join", [RID] + GAZ, lambda s: (
    f"WITH {QSQL}, c AS (SELECT q.request_id, g1.lat AS o_city_lat, g1.lon AS o_city_lon, g2.lat AS d_city_lat, "
    f"g2.lon AS d_city_lon FROM q_valid q LEFT JOIN gaz g1 ON lower({O.strip('q.origin')}) = g1.city "
    f"LEFT JOIN gaz g2 ON lower({O.strip('q.destination')}) = g2.city) SELECT {s} FROM c"))
def q_c4(spark, sf_dir):
    """C4: gazetteer coordinates of both ends (broadcast joins)."""
    valid, _ = R.validate_requests(requests_view(spark, sf_dir))
    return P.add_city_coords(R.normalize_requests(valid), spark)


VEH = [("vehicle_type", "s")] + [(a, "d") for a in ("toll", "wage", "maint", "mob", "lam")]


@register("C5_vehicle_join", [RID] + VEH, lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, vehicle_type, "
    + ", ".join(f"{O._veh_case('vehicle_type', a)} AS {a}" for a in ("toll", "wage", "maint", "mob", "lam"))
    + f" FROM q_valid) SELECT {s} FROM c"))
def q_c5(spark, sf_dir):
    """Vehicle class attributes (normalised class, unknown -> FTL)."""
    valid, _ = R.validate_requests(requests_view(spark, sf_dir))
    df = R.normalize_requests(valid)
    for a in ("toll", "wage", "maint", "mob", "lam"):
        df = df.withColumn(a, vehicle_attr(F.col("vehicle_type"), a))
    return df


C6 = [RID, ("pos", "i"), ("addon", "s"), ("label", "s"), ("amount", "i")]


@register("C6_addon_join", C6, lambda s: (
    f"WITH {QSQL}, e AS (SELECT request_id, rp, unnest(addons) AS addon, "
    f"unnest(generate_series(0, len(addons) - 1)) AS pos FROM quotes2), c AS (SELECT request_id, pos, addon, "
    f"CASE addon " + " ".join(f"WHEN '{k}' THEN '{lab.replace(chr(39), chr(39) * 2)}'" for k, (lab, _, _) in O.V.addons.items())
    + " END AS label, CASE addon " + " ".join(f"WHEN '{k}' THEN CAST({c} AS BIGINT)" for k, (_, c, _) in O.V.addons.items() if c)
    + " " + " ".join(f"WHEN '{k}' THEN CAST({O.pyr(f'rp * {O.d(p)}', 0)} AS BIGINT)" for k, (_, _, p) in O.V.addons.items() if p)
    + f" END AS amount FROM e) SELECT {s} FROM c"))
def q_c6(spark, sf_dir):
    """One row per selected add-on (position kept) joined to its label and amount."""
    q = _quotes(spark, sf_dir)
    ex = q.select("request_id", F.posexplode(F.arrays_zip("addons", "addon_amounts")).alias("pos", "z"))
    labels = F.create_map(*[x for k, (lab, _, _) in K.ADDON_CONFIG.items() for x in (F.lit(k), F.lit(lab))])
    return ex.select("request_id", "pos", F.col("z.addons").alias("addon"), labels[F.col("z.addons")].alias("label"),
                     F.col("z.addon_amounts").alias("amount"))


C7 = [RID, ("req_road_km", "d"), ("gaz_road_km", "d")]


@register("C7_road_distance_join", C7, lambda s: (
    f"WITH {QSQL}, c AS (SELECT q.request_id, rq.km AS req_road_km, rg.km AS gaz_road_km FROM q_valid q "
    f"LEFT JOIN gaz g1 ON lower({O.strip('q.origin')}) = g1.city LEFT JOIN gaz g2 ON lower({O.strip('q.destination')}) = g2.city "
    f"LEFT JOIN road_km rq ON round(q.origin_lat, 4) = rq.r1 AND round(q.origin_lon, 4) = rq.r2 AND round(q.dest_lat, 4) = rq.r3 AND round(q.dest_lon, 4) = rq.r4 "
    f"LEFT JOIN road_km rg ON round(g1.lat, 4) = rg.r1 AND round(g1.lon, 4) = rg.r2 AND round(g2.lat, 4) = rg.r3 AND round(g2.lon, 4) = rg.r4) SELECT {s} FROM c"))
def q_c7(spark, sf_dir):
    """Road km of the request's own coordinates and of the gazetteer's (0 is missing, least of several)."""
    return _prepared(spark, sf_dir)


@register("A9_scan_requests", [RID, ("origin", "s"), ("destination", "s"), ("trip_date", "s"), ("weight_tonnes", "d"),
                               ("vehicle_type", "s"), ("competitor_price", "d"), ("diesel_price", "d"), ("addon_list", "s"),
                               ("origin_lat", "d"), ("origin_lon", "d"), ("dest_lat", "d"), ("dest_lon", "d"),
                               ("corrupt", "b")],
          lambda s: f"WITH {O.requests_sql()}, c AS (SELECT *, array_to_string(addons, ',') AS addon_list, "
                    f"false AS corrupt FROM req_raw) SELECT {s} FROM c")
def q_a9(spark, sf_dir):
    """The requests as JSON lines, read back with the fixed schema."""
    path = scratch_dir(spark, "requests-json")
    requests_view(spark, sf_dir).drop("p_delay", "eff").write.json(path)
    return scan_requests(spark, path).withColumns({"addon_list": F.array_join("addons", ","),
                                                   "corrupt": F.col("_corrupt_record").isNotNull()})


A10 = [RID, ("final_price", "i"), ("status", "s"), ("p_min", "d"), ("p_max", "d"), ("is_feasible", "b"), ("addon_total", "i"),
       ("distance_km", "d"), ("n_addons", "i")]


@register("A10_write_quotes", A10, lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, final_price, status, p_min, p_max, is_feasible, addon_total, distance_km, "
    f"len(addons) AS n_addons FROM quotes2) SELECT {s} FROM c"))
def q_a10(spark, sf_dir):
    """A10: the nested quote documents written as JSON lines and read back."""
    path = scratch_dir(spark, "quote-documents")
    doc = Q.quote_document(_quotes(spark, sf_dir))
    write_quotes(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return back.select("request_id", "final_price", "status", "pricing.corridor.p_min", "pricing.corridor.p_max",
                       "pricing.feasibility.is_feasible", F.col("addons.total").alias("addon_total"),
                       "abstraction.distance_km", F.size("addons.selected").alias("n_addons"))


@register("H12_filter_known", [RID, ("known", "s"), ("n_dropped", "i")], lambda s: (
    f"WITH {O.requests_sql()}, c AS (SELECT request_id, array_to_string(list_filter(coalesce(addons, []), "
    f"lambda x: x IN {tuple(O.V.addons)}), ',') AS known, len(list_filter(coalesce(addons, []), "
    f"lambda x: x NOT IN {tuple(O.V.addons)})) AS n_dropped FROM req_raw) SELECT {s} FROM c"))
def q_h12(spark, sf_dir):
    """Known add-on ids of each request (order and repeats kept), and how many are unknown."""
    given = F.coalesce("addons", F.array().cast("array<string>"))
    known = R.filter_known(given, F.array(*[F.lit(a) for a in K.ADDON_CONFIG]))
    return requests_view(spark, sf_dir).select("request_id", F.array_join(known, ",").alias("known"),
                                               (F.size(given) - F.size(known)).alias("n_dropped"))


H14 = [RID, ("efficiency", "s"), ("confidence", "s"), ("distance", "i"), ("risk", "s")]


@register("H14_bands", H14, lambda s: (
    f"WITH {O.requests_sql()}, c AS (SELECT request_id, CASE WHEN eff >= 0.85 THEN 'Elite' WHEN eff >= 0.65 THEN 'High' "
    f"WHEN eff >= 0.35 THEN 'Medium' ELSE 'Low' END AS efficiency, CASE WHEN eff >= 0.82 THEN 'Elite' WHEN eff >= 0.62 "
    f"THEN 'High' WHEN eff >= 0.42 THEN 'Moderate' ELSE 'Low' END AS confidence, CASE WHEN weight_tonnes * 20 < 200 THEN 0 "
    f"WHEN weight_tonnes * 20 < 500 THEN 1 ELSE 2 END AS distance, CASE WHEN p_delay < 0.3 THEN 'Low Risk' ELSE 'High Risk' "
    f"END AS risk FROM req_raw) SELECT {s} FROM c"))
def q_h14(spark, sf_dir):
    """Efficiency, confidence, distance and risk bands of given values."""
    return requests_view(spark, sf_dir).select(
        "request_id", E.efficiency_band("eff").alias("efficiency"), E.confidence_band("eff").alias("confidence"),
        E.distance_category(F.col("weight_tonnes") * 20).alias("distance"), E.delay_risk_label("p_delay").alias("risk"))


# --- H over requests -------------------------------------------------------------------------------

@register("H2_place_key", [RID, ("ok", "s"), ("dk", "s")], lambda s: (
    f"WITH {O.requests_sql()}, c AS (SELECT request_id, lower({O.strip('origin')}) AS ok, "
    f"lower({O.strip('destination')}) AS dk FROM req_raw) SELECT {s} FROM c"))
def q_h2(spark, sf_dir):
    """H2: strip + lower of the request place names."""
    r = requests_view(spark, sf_dir)
    return r.select("request_id", E.place_key("origin").alias("ok"), E.place_key("destination").alias("dk"))


_quote_query("H5_season", [("month", "i"), ("season", "s"), ("is_peak_month", "i")], "H5: month -> season, peak flag.")
_quote_query("H6_day_name", [("day_of_week", "i"), ("day_name", "s"), ("formatted_date", "s")],
             "H6: weekday, day name and 'dd Mon yyyy' text of the trip date.")
_quote_query("H7_arrival_time", [("arrival_time", "s"), ("expected_dwell_h", "d")],
             "H7: 06:00 departure + km / 50 h, shown as 'HH:mm, Day'.")


@register("H8_haversine_km", [RID, ("haversine_km", "d")], lambda s: (
    f"WITH {QSQL}, c AS (SELECT q.request_id, {O.d(6371)} * 2 * asin(sqrt(pow(sin(radians(g2.lat - g1.lat) / 2), 2) "
    f"+ cos(radians(g1.lat)) * cos(radians(g2.lat)) * pow(sin(radians(g2.lon - g1.lon) / 2), 2))) AS haversine_km "
    f"FROM q_valid q JOIN gaz g1 ON lower({O.strip('q.origin')}) = g1.city "
    f"JOIN gaz g2 ON lower({O.strip('q.destination')}) = g2.city) SELECT {s} FROM c"))
def q_h8(spark, sf_dir):
    """H8: great-circle km between the gazetteer coordinates of both ends."""
    valid, _ = R.validate_requests(requests_view(spark, sf_dir))
    df = P.add_city_coords(R.normalize_requests(valid), spark).where(
        F.col("o_city_lat").isNotNull() & F.col("d_city_lat").isNotNull())
    return df.withColumn("haversine_km", E.haversine_km("o_city_lat", "o_city_lon", "d_city_lat", "d_city_lon"))


@register("H11_survival_note", [RID, ("note", "s")], lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, CASE WHEN is_feasible THEN 'Trip covers driver survival earnings.' "
    f"ELSE 'Price raised to survival floor Rs ' || format('{{:,.0f}}', c_survival) || ' — review route viability.' END "
    f"AS note FROM quotes2) SELECT {s} FROM c"))
def q_h11(spark, sf_dir):
    """Feasibility note (fixed text, or the survival amount with thousands separators)."""
    return _quotes(spark, sf_dir).withColumn("note", E.survival_note("is_feasible", "c_survival"))


@register("H13_addon_breakdown", [RID, ("n_entries", "i"), ("express_amount", "i")], lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, len(list_distinct(addons)) AS n_entries, "
    f"CASE WHEN list_contains(addons, 'express_delivery') THEN CAST({O.pyr(f'rp * {O.d(0.30)}', 0)} AS BIGINT) END "
    f"AS express_amount FROM quotes2) SELECT {s} FROM c"))
def q_h13(spark, sf_dir):
    """Add-on breakdown map (one entry per id; repeats collapse)."""
    q = _quotes(spark, sf_dir)
    return q.select("request_id", F.size(F.map_keys("addon_breakdown")).alias("n_entries"),
                    F.col("addon_breakdown")["express_delivery"]["amount"].alias("express_amount"))


_quote_query("D13_addon_total", [("addon_total", "i")], "D13: sum of add-on amounts, repeats counted each time.")

# --- J ----------------------------------------------------------------------------------------------

_quote_query("J1_distance_cascade", [("distance_km", "d"), ("distance_method", "s")],
             "J1: road table / gazetteer haversine x 1.32 / lane average / 500 km, with the method.")
_quote_query("J2_loaded_mileage", [("m_loaded", "d")], "J2: loaded km per litre.")
_quote_query("J3_empty_mileage", [("m_empty", "d")], "J3: empty km per litre.")


@register("J4_active_hours", [RID, ("T_active_h", "d")], lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, T_active_raw AS T_active_h FROM quotes2) SELECT {s} FROM c"))
def q_j4(spark, sf_dir):
    """Dwell hours counted in the 08:00-20:00 window."""
    return _quotes(spark, sf_dir)


_quote_query("J5_p_return", [("p_return", "d")], "J5: return-load probability by time decay.")
_quote_query("J6_decision_confidence", [("confidence_score", "d"), ("confidence_label", "s")],
             "J6: decision confidence score and label.")
_quote_query("J7_layer1_operational", [("fuel_loaded_cost", "d"), ("fuel_empty_cost", "d"), ("tolls", "d"), ("wages", "d"),
                                       ("maintenance", "d"), ("mobilization", "d"), ("c_base", "d")],
             "J7: operational base cost.")


@register("J8_layer2_return_risk", [RID, ("c_risk", "d")], lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, {O.pyr('c_risk', 2)} AS c_risk FROM quotes2) SELECT {s} FROM c"))
def q_j8(spark, sf_dir):
    """(1 - p_return) x empty-run fuel cost, with the document's rounding (2 digits)."""
    return _quotes(spark, sf_dir).withColumn("c_risk", E.py_round("c_risk", 2))


_quote_query("J9_layer3_corridor", [("p_min", "d"), ("p_max", "d")], "J9: corridor with the ML multiplier.")


@register("J10_layer4_snap", [RID, ("floor", "d"), ("ceiling", "d"), ("was_snapped", "b")], lambda s: (
    f"WITH {QSQL}, c AS (SELECT *, competitor_price IS NOT NULL AND competitor_price > 0 AS was_snapped FROM quotes2) "
    f"SELECT {s} FROM c"))
def q_j10(spark, sf_dir):
    """Competitive snap of the corridor."""
    return _quotes(spark, sf_dir)


_quote_query("J11_layer5_gate", [("c_survival", "d"), ("is_feasible", "b"), ("recommended", "d")],
             "J11: survival gate and recommended price.")
_quote_query("J12_trip_status", [("status", "s")], "J12: Healthy / Low Margin / Infeasible.")
_quote_query("J13_addon_amounts", [("recommended_price", "d"), ("addon_total", "i")], "J13: add-on amounts and total.")
_quote_query("J14_final_price", [("final_price", "i")], "J14: round-half-even(recommended + add-ons).")
_quote_query("J15_efficiency_band", [("efficiency_score", "d"), ("efficiency_label", "s")],
             "J15: service efficiency bands.")


J16 = [("TRANSPORTATION_DISTANCE_IN_KM", "d"), ("day_of_week", "i"), ("month", "i"), ("lane_popularity", "d"),
       ("route_risk", "d"), ("driver_delay_rate", "d"), ("is_return_trip", "i"), ("is_deadhead", "i"),
       ("is_peak_month", "i"), ("distance_category", "i"), ("lane_maturity", "d"), ("is_market", "i")]


@register("J16_request_features", [RID] + J16, lambda s: (
    f"WITH {QSQL}, c AS (SELECT *, distance_km AS TRANSPORTATION_DISTANCE_IN_KM, 0 AS is_return_trip, 0 AS is_deadhead, "
    f"CASE WHEN distance_km < 200 THEN 0 WHEN distance_km < 500 THEN 1 ELSE 2 END AS distance_category, "
    f"ln(1 + CAST(trip_count AS DOUBLE)) AS lane_maturity, 0 AS is_market FROM q_dist) SELECT {s} FROM c"))
def q_j16(spark, sf_dir):
    """Model feature row of each request."""
    return P.add_request_features(_prepared(spark, sf_dir), K.CORE_FEATURES + K.EXTENDED_FEATURES)


J17 = [("distance_km", "d"), ("distance_method", "s"), ("day_name", "s"), ("season", "s"), ("is_peak_season", "b"),
       ("m_loaded_kmpl", "d"), ("m_empty_kmpl", "d"), ("lane_popularity", "d"), ("route_risk", "d"),
       ("lane_trip_count", "i"), ("vehicle_type", "s"), ("diesel_price", "d"), ("diesel_source", "s")]


@register("J17_abstraction_block", [RID] + J17, lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, distance_km, distance_method, day_name, season, is_peak_month = 1 AS is_peak_season, "
    f"m_loaded AS m_loaded_kmpl, m_empty AS m_empty_kmpl, {O.pyr('lane_popularity', 3)} AS lane_popularity, "
    f"{O.pyr('route_risk', 3)} AS route_risk, trip_count AS lane_trip_count, vehicle_type, "
    f"{O.pyr('diesel_price', 2)} AS diesel_price, diesel_source FROM quotes2) SELECT {s} FROM c"))
def q_j17(spark, sf_dir):
    """Context block of each quote."""
    q = _quotes(spark, sf_dir)
    return q.select("request_id", P.abstraction(q).alias("a")).select("request_id", "a.*")


FLAT = [("origin", "s"), ("destination", "s"), ("trip_date", "s"), ("weight_tonnes", "d"), ("vehicle_type", "s"),
        ("lane_match", "s"), ("distance_km", "d"), ("distance_method", "s"), ("season", "s"), ("day_name", "s"),
        ("efficiency_score", "d"), ("efficiency_label", "s"), ("delay_probability", "d"), ("p_return", "d"),
        ("confidence_score", "d"), ("confidence_label", "s"), ("arrival_time", "s"), ("T_active_1dp", "d")] + \
       [(k, "d") for k in Q.FLAT_2DP] + [("is_feasible", "b"), ("status", "s"), ("addon_total", "i"), ("final_price", "i")]


_ORACLE_J18 = lambda s: (
    f"WITH {QSQL}, c AS (SELECT request_id, origin, destination, formatted_date AS trip_date, weight_tonnes, vehicle_type, "
    f"lane_match, distance_km, distance_method, season, day_name, {O.pyr('efficiency_score', 4)} AS efficiency_score, "
    f"efficiency_label, {O.pyr('delay_probability', 4)} AS delay_probability, {O.pyr('p_return', 4)} AS p_return, "
    f"confidence_score, confidence_label, arrival_time, {O.pyr('T_active_raw', 1)} AS T_active_1dp, "
    + ", ".join(f"{O.pyr(k if k != 'recommended_price' else 'rp', 2)} AS {k}" for k in Q.FLAT_2DP)
    + f", is_feasible, status, addon_total, final_price FROM quotes2) SELECT {s} FROM c")


@register("J18_quote_requests", [RID] + FLAT, _ORACLE_J18)
def q_j18(spark, sf_dir):
    """Requests -> priced quotes (scores given as columns), flattened."""
    return Q.flat_quotes(_quotes(spark, sf_dir)).withColumnRenamed("T_active_h", "T_active_1dp")


J19 = [("delay_risk_label", "s"), ("decay_hours", "d"), ("corridor_position_pct", "d"), ("corridor_marker_pct", "d"),
       ("efficiency_colour", "s")]


@register("J19_display_derivations", [RID] + J19, lambda s: (
    f"WITH {QSQL}, c0 AS (SELECT *, CASE WHEN floor < ceiling THEN (rp - floor) / (ceiling - floor) * {O.d(100)} "
    f"ELSE {O.d(50)} END AS pos FROM quotes2), c AS (SELECT request_id, "
    f"CASE WHEN delay_probability < {O.d(0.3)} THEN 'Low Risk' ELSE 'High Risk' END AS delay_risk_label, "
    f"{O.pyr('T_active_raw', 1)} - {O.d(4)} AS decay_hours, pos AS corridor_position_pct, "
    f"least({O.d(95)}, greatest({O.d(5)}, pos)) AS corridor_marker_pct, "
    f"CASE WHEN efficiency_score >= {O.d(0.75)} THEN '#34d399' WHEN efficiency_score >= {O.d(0.5)} THEN '#22d3ee' "
    f"WHEN efficiency_score >= {O.d(0.35)} THEN '#fbbf24' ELSE '#f87171' END AS efficiency_colour FROM c0) SELECT {s} FROM c"))
def q_j19(spark, sf_dir):
    """Dashboard-derived values (risk label, decay hours, corridor position, colour band)."""
    return P.display_derivations(_quotes(spark, sf_dir))


@register("L1_quote_stream", [RID] + FLAT, _ORACLE_J18)
def q_l1(spark, sf_dir):
    """L1: request documents (JSON lines, some broken) read as a stream, priced per micro-batch, read back by commits."""
    from lanecast.sources.requests import stream_requests
    from lanecast.streaming.quotes import read_quotes, start_quote_stream
    source, sink = scratch_dir(spark, "request-files"), scratch_dir(spark, "quote-sink")
    request_documents(requests_view(spark, sf_dir)).write.text(source)
    query = start_quote_stream(stream_requests(spark, source, SCORES), _index(spark, sf_dir), None, sink,
                               f"{sink}/_checkpoint", road=road_view(spark, sf_dir))
    query.awaitTermination()
    return read_quotes(spark, sink).withColumnRenamed("T_active_h", "T_active_1dp")


#: The stand-in scores of the requests view, beside the request fields.
SCORES = "p_delay double, eff double"


def request_documents(requests: DataFrame) -> DataFrame:
    """JSON lines of the requests, and after every 50th (by hash) the line once more with its end cut off."""
    line = F.to_json(F.struct(*[F.col(c) for c in requests.columns]))
    cut = F.when(F.crc32(F.col("request_id").cast("binary")) % 50 == 0, F.substring(line, 1, 40))
    return requests.select(F.explode(F.array_compact(F.array(line, cut))).alias("value"))
