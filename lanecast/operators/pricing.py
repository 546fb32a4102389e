"""Distance cascade and the five pricing layers.

Rounding follows Python's ``round`` (exact binary half-even, ``py_round``), as the service did.

Every value is a column expression over one request row; the only joins are the
broadcast gazetteer (fixed 81 rows) and the optional road-distance table (of the gazetteer's pairs: broadcast, too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.functions import expr as E
from lanecast.sources.dims import gazetteer, vehicle_attr


def c(name: str) -> Column:
    return F.col(name)


# --- H5 / H6 temporal --------------------------------------------------------------------

def add_temporal(df: DataFrame, date_col: str = "trip_day") -> DataFrame:
    """H4-H6: weekday, month, season, peak flag, day name and formatted date of the trip day."""
    d = c(date_col)
    m = F.month(d)
    return df.withColumns({"day_of_week": F.weekday(d), "month": m, "season": E.season(m),
                           "is_peak_month": E.is_peak_month(m).cast("int"), "day_name": F.date_format(d, "EEEE"),
                           "formatted_date": F.date_format(d, "dd MMM yyyy")})


# --- C4 / C7 / H8 / J1 distance ----------------------------------------------------------------

def add_city_coords(df: DataFrame, spark) -> DataFrame:
    """C4: gazetteer coordinates of origin and destination (broadcast, fixed 81 rows)."""
    g = F.broadcast(gazetteer(spark))
    o = g.select(F.col("city").alias("_oc"), F.col("lat").alias("o_city_lat"), F.col("lon").alias("o_city_lon"))
    d = g.select(F.col("city").alias("_dc"), F.col("lat").alias("d_city_lat"), F.col("lon").alias("d_city_lon"))
    out = df.withColumn("_oc", F.lower(E.strip("origin"))).withColumn("_dc", F.lower(E.strip("destination")))
    return out.join(o, "_oc", "left").join(d, "_dc", "left").drop("_oc", "_dc")


COORDS = ("lat1", "lon1", "lat2", "lon2")


def _road_km(road: DataFrame, keys: list[str], name: str, pairs: DataFrame | None = None) -> DataFrame:
    """The known road km by rounded coordinates, of ``pairs`` (few ``keys``) only where they are given.

    A km of 0, NULL or NaN counts as missing; of several known values for one pair the smallest is taken.
    """
    r = road.select(*[F.round(c(x), 4).alias(k) for k, x in zip(keys, COORDS)],
                    F.nullif(E.not_nan(c("km")), F.lit(0.0)).alias(name)).where(c(name).isNotNull())
    if pairs is not None:
        r = r.join(F.broadcast(pairs), keys)
    return r.groupBy(*keys).agg(F.min(name).alias(name))


def add_request_road(df: DataFrame, road: DataFrame | None) -> DataFrame:
    """``req_road_km``, the road km (if known) of the request's own coordinates, rounded to 4 decimals.

    Only rows with all four coordinates are shuffled for it; ``df`` is read twice.
    """
    name = "req_road_km"
    none = F.lit(None).cast("double").alias(name)
    if road is None:
        return df.select("*", none)
    own = [c(x) for x in ("origin_lat", "origin_lon", "dest_lat", "dest_lon")]
    known = own[0].isNotNull() & own[1].isNotNull() & own[2].isNotNull() & own[3].isNotNull()
    keys = [f"_req{i}" for i in range(4)]
    keyed = df.where(known).withColumns({k: F.round(x, 4) for k, x in zip(keys, own)})
    found = keyed.join(_road_km(road, keys, name), keys, "left").select(*df.columns, name)
    return found.unionAll(df.where(~known).select(*df.columns, none))


def add_gazetteer_road(df: DataFrame, spark, road: DataFrame | None) -> DataFrame:
    """``gaz_road_km``, the road km (if known) between the gazetteer's coordinates of both ends.

    The gazetteer is fixed, so at most 81 x 81 pairs of the road table matter; they are broadcast.
    """
    name = "gaz_road_km"
    if road is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    keys = [f"_gaz{i}" for i in range(4)]
    at = gazetteer(spark).select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    pairs = at.toDF(*keys[:2]).crossJoin(F.broadcast(at.toDF(*keys[2:])))
    city = [c(x) for x in ("o_city_lat", "o_city_lon", "d_city_lat", "d_city_lon")]
    keyed = df.withColumns({k: F.round(x, 4) for k, x in zip(keys, city)})
    return keyed.join(F.broadcast(_road_km(road, keys, name, pairs)), keys, "left").drop(*keys)


def add_distance(df: DataFrame, spark, road: DataFrame | None = None) -> DataFrame:
    """Request coordinates + road table, then gazetteer (road table, else haversine x 1.32),
    then the lane average if positive, then 500 km; rounded to 1 digit with the method name.

    Rows that have their ``req_road_km`` already keep it."""
    out = df if "req_road_km" in df.columns else add_request_road(df, road)
    out = add_gazetteer_road(add_city_coords(out, spark), spark, road)
    has_req = (c("origin_lat").isNotNull() & c("origin_lon").isNotNull()
               & c("dest_lat").isNotNull() & c("dest_lon").isNotNull())
    has_gaz = c("o_city_lat").isNotNull() & c("d_city_lat").isNotNull()
    hav = E.haversine_km("o_city_lat", "o_city_lon", "d_city_lat", "d_city_lon") * F.lit(K.ROAD_FACTOR)
    avg = c("avg_dist_km")
    raw = (F.when(has_req & c("req_road_km").isNotNull(), c("req_road_km"))
           .when(has_gaz & c("gaz_road_km").isNotNull(), c("gaz_road_km"))
           .when(has_gaz, hav).when(avg > 0, avg).otherwise(F.lit(K.DEFAULT_DISTANCE_KM)))
    method = (F.when(has_req & c("req_road_km").isNotNull(), F.lit("osrm"))
              .when(has_gaz & c("gaz_road_km").isNotNull(), F.lit("osrm"))
              .when(has_gaz, F.lit("haversine"))
              .when(avg > 0, F.lit("historical_avg"))
              .otherwise(F.lit("default_fallback")))
    # rounding repeats its argument, so that is a column of its own
    return (out.withColumns({"_km": raw, "distance_method": method})
            .withColumn("distance_km", E.py_round("_km", 1)).drop("_km"))


# --- J2 / J3 mileage -------------------------------------------------------------------------------

def _mileage(curves: dict, adjust: tuple, w: Column, vt: Column, km: Column) -> Column:
    def curve(name):
        floor, icpt, slope = curves[name]
        return F.greatest(F.lit(floor), F.lit(icpt) - F.lit(slope) * w)
    base = (F.when(vt == "LCV", curve("LCV")).when(vt == "MCV", curve("MCV"))
            .when(vt == "CARTING", curve("CARTING")).otherwise(curve("OTHER")))
    bonus, penalty, floor = adjust
    shift = F.when(km > K.LONG_HAUL_KM, F.lit(bonus)).when(km < K.SHORT_HAUL_KM, F.lit(-penalty)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(floor), base + shift)


def loaded_mileage(w, vt, km) -> Column:
    """Km per litre loaded, before its rounding to 2 digits."""
    return _mileage(K.LOADED_MILEAGE, K.LOADED_ADJUST, E.col(w), E.col(vt), E.col(km))


def empty_mileage(w, vt, km) -> Column:
    """Km per litre empty, before its rounding to 2 digits."""
    return _mileage(K.EMPTY_MILEAGE, K.EMPTY_ADJUST, E.col(w), E.col(vt), E.col(km))


# --- J4 / J5 return probability -------------------------------------------------------------------

def active_hours(h: Column, dwell: Column) -> Column:
    """Dwell counted inside the 08-20 window; overflow beyond the day counts half."""
    start, end, hours = K.BUSINESS_START, K.BUSINESS_END, K.BUSINESS_HOURS
    effective = (F.when(h < start, F.greatest(F.lit(0.0), dwell - (F.lit(start) - h)))
                 .when(h >= end, F.greatest(F.lit(0.0), dwell - ((F.lit(24.0) - h) + F.lit(start))))
                 .otherwise(dwell))
    remaining = F.when((h < start) | (h >= end), F.lit(hours)).otherwise(F.lit(end) - h)
    return F.when(effective <= remaining, effective).otherwise(
        remaining + (effective - remaining) * F.lit(hours / 24.0))


def add_p_return(df: DataFrame) -> DataFrame:
    """J5 (+H7): arrival from a 06:00 departure at 50 km/h, expected dwell, active hours, p_return."""
    lam = vehicle_attr(c("vehicle_type"), "lam")
    departure = F.to_timestamp_ntz(F.date_format(c("trip_day"), "yyyy-MM-dd")) + F.make_dt_interval(
        hours=F.lit(K.DEPARTURE_HOUR))
    travel_us = F.rint(c("distance_km") / F.lit(K.AVG_SPEED_KMPH) * F.lit(3_600_000_000.0)).cast("long")
    arrival = F.timestamp_add("MICROSECOND", travel_us, departure)
    out = df.withColumns({"_lam": lam, "arrival": arrival,
                          "expected_dwell_h": F.lit(K.T_GRACE) + (F.lit(1.0) - c("lane_popularity")) * F.lit(20.0)})
    out = out.withColumn("_h", F.hour("arrival") + F.minute("arrival") / F.lit(60.0))
    out = out.withColumn("T_active_h", active_hours(c("_h"), c("expected_dwell_h")))
    p = F.exp(-c("_lam") * F.greatest(F.lit(0.0), c("T_active_h") - F.lit(K.T_GRACE)))
    out = out.withColumn("p_return", E.clip(p, 0.05, 0.99))
    model = F.struct(
        F.date_format("arrival", "HH:mm, EEE").alias("arrival_time"),
        E.py_round(c("expected_dwell_h"), 1).alias("expected_dwell_h"),
        E.py_round(c("T_active_h"), 1).alias("T_active_h"),
        F.lit(K.T_GRACE).alias("T_grace_h"),
        c("_lam").alias("lambda"),
        c("vehicle_type").alias("vehicle_type"),
        (c("T_active_h") <= K.T_GRACE).alias("within_grace"))
    return (out.withColumn("p_return_model", model).withColumn("arrival_time", model["arrival_time"])
            .drop("_h", "_lam"))


# --- J6 / J15 -------------------------------------------------------------------------------------

def add_confidence(df: DataFrame) -> DataFrame:
    """Decision confidence from lane trips, model certainty and the distance method."""
    data_conf = F.least(F.lit(1.0), c("trip_count").cast("double") / F.lit(K.CONFIDENCE_TRIPS))
    model_conf = F.lit(0.5) + F.abs(c("efficiency_score") - F.lit(0.5)) * F.lit(K.CONFIDENCE_SPREAD)
    pen = F.when(c("distance_method").isin("historical_avg", "osrm"), F.lit(0.0)).otherwise(
        F.lit(K.CONFIDENCE_PENALTY))
    raw = E.clip((data_conf * F.lit(K.CONFIDENCE_DATA) + model_conf * F.lit(K.CONFIDENCE_MODEL)) - pen,
                 *K.CONFIDENCE_RANGE)
    return (df.withColumn("_confidence", raw)
            .withColumns({"confidence_label": E.confidence_band("_confidence"),
                          "confidence_score": E.py_round("_confidence", 3)}).drop("_confidence"))


# --- J7 - J12 pricing layers ---------------------------------------------------------------------

def add_pricing(df: DataFrame) -> DataFrame:
    """J7 operational base, J8 return risk, J9 corridor, J10 competitive snap, J11 gate, J12 status.

    Columns are added in dependency layers (one ``withColumns`` per layer) to keep the plan short.
    """
    km, w, vt, diesel = c("distance_km"), c("weight_tonnes"), c("vehicle_type"), c("diesel_price")
    toll, wage = vehicle_attr(vt, "toll"), vehicle_attr(vt, "wage")
    maint, mob = vehicle_attr(vt, "maint"), vehicle_attr(vt, "mob")
    round_h = km * F.lit(2.0) / F.lit(K.AVG_SPEED_KMPH)
    out = df.withColumns({"_m_loaded": loaded_mileage(w, vt, km), "_m_empty": empty_mileage(w, vt, km),
                          "_toll": toll, "tolls": F.lit(2.0) * km * toll,
                          "wages": round_h / F.lit(24.0) * wage, "maintenance": round_h / F.lit(24.0) * maint,
                          "mobilization": mob})
    out = out.withColumns({"m_loaded": E.py_round("_m_loaded", 2), "m_empty": E.py_round("_m_empty", 2)})
    out = out.withColumns({"fuel_loaded_L": km / c("m_loaded"), "fuel_empty_L": km / c("m_empty")})
    out = out.withColumns({"fuel_loaded_cost": c("fuel_loaded_L") * diesel,
                           "fuel_empty_cost": c("fuel_empty_L") * diesel})
    delay_prem = c("delay_probability") * F.lit(K.DELAY_PREMIUM)
    eff_adj = (F.lit(0.5) - c("efficiency_score")) * F.lit(K.EFFICIENCY_ADJUST)
    out = out.withColumns({
        "c_base": c("fuel_loaded_cost") + c("tolls") + c("wages") + c("maintenance") + c("mobilization"),
        "c_risk": (F.lit(1.0) - c("p_return")) * c("fuel_empty_cost"),
        "ml_delay_premium": delay_prem, "ml_eff_adjustment": eff_adj,
        "ml_multiplier": E.clip(F.lit(1.0) + delay_prem + eff_adj, *K.MULTIPLIER_RANGE),
        "c_survival": c("fuel_loaded_cost") + km * c("_toll") + F.lit(K.SURVIVAL_WAGE_SHARE) * c("wages")})
    out = out.withColumn("_p_min", (c("c_base") + c("c_risk")) * c("ml_multiplier"))
    out = out.withColumn("p_min", E.py_round("_p_min", 2)).withColumn("_p_max", c("p_min") * F.lit(K.CORRIDOR_WIDTH))
    out = out.withColumn("p_max", E.py_round("_p_max", 2))
    comp = c("competitor_price")
    snapped = comp.isNotNull() & (comp > 0)
    floor = F.when(snapped, F.greatest(c("p_min"), comp * F.lit(1.0 - K.EPSILON_LOW))).otherwise(c("p_min"))
    ceil0 = F.when(snapped, F.least(c("p_max"), comp * F.lit(1.0 + K.EPSILON_HIGH))).otherwise(c("p_max"))
    out = out.withColumns({"premium": c("p_max") - c("p_min"), "floor": floor, "_ceil0": ceil0, "was_snapped": snapped})
    out = out.withColumns({"ceiling": F.when(c("floor") > c("_ceil0"), c("floor")).otherwise(c("_ceil0")),
                           "is_feasible": c("floor") >= c("c_survival"),
                           "recommended": F.when(c("floor") >= c("c_survival"), c("floor")).otherwise(c("c_survival"))})
    margin = F.when(c("c_base") > 0, (c("recommended") - c("c_survival")) / c("c_base")).otherwise(F.lit(0.0))
    status = (F.when(c("recommended") < c("c_survival"), F.lit("Infeasible"))
              .when(margin >= K.HEALTHY_MARGIN, F.lit("Healthy")).otherwise(F.lit("Low Margin")))
    return out.withColumn("status", status).drop("_toll", "_ceil0", "_m_loaded", "_m_empty", "_p_min", "_p_max")


# --- J13 / J14 / D13 / H13 add-ons ------------------------------------------------------------------

def add_addons(df: DataFrame) -> DataFrame:
    """Per selected add-on a fixed cost or round(base x share); D13 total counts repeats;
    H13 breakdown map keeps one entry per id; J14 final price = round(base + total)."""
    labels = F.create_map(*[x for k, (label, _, _) in K.ADDON_CONFIG.items() for x in (F.lit(k), F.lit(label))])
    shares = {k: pct for k, (_, _, pct) in K.ADDON_CONFIG.items() if pct is not None}
    out = df.withColumn("recommended_price", E.py_round("recommended", 2))
    out = out.withColumns({f"_raw_{k}": c("recommended_price") * F.lit(pct) for k, pct in shares.items()})
    amounts = F.create_map(*[x for k, (_, cost, _) in K.ADDON_CONFIG.items() for x in (
        F.lit(k), E.py_round(f"_raw_{k}", 0).cast("long") if k in shares else F.lit(cost).cast("long"))])
    out = out.withColumn("_amounts", amounts)
    out = out.withColumns({
        "addon_amounts": F.transform("addons", lambda k: c("_amounts")[k]),
        "addon_breakdown": F.map_from_entries(F.transform(F.array_distinct("addons"), lambda k: F.struct(
            k.alias("key"), F.struct(labels[k].alias("label"), c("_amounts")[k].alias("amount")).alias("value"))))})
    out = out.withColumn("addon_total", F.aggregate("addon_amounts", F.lit(0).cast("long"), lambda a, x: a + x))
    out = out.withColumn("_final", c("recommended_price") + c("addon_total").cast("double"))
    return out.withColumn("final_price", E.py_round("_final", 0).cast("long")).drop(
        "_final", "_amounts", *[f"_raw_{k}" for k in shares])


# --- J16 / J17 / J19 -----------------------------------------------------------------------------------

def add_request_features(df: DataFrame, base_features: list[str]) -> DataFrame:
    """Model inputs of a request (return/deadhead/is_market are 0; maturity from KB trips)."""
    out = (df.withColumn("TRANSPORTATION_DISTANCE_IN_KM", c("distance_km"))
           .withColumn("is_return_trip", F.lit(0)).withColumn("is_deadhead", F.lit(0))
           .withColumn("distance_category", E.distance_category("distance_km"))
           .withColumn("lane_maturity", F.log1p(c("trip_count").cast("double")))
           .withColumn("is_market", F.lit(0)))
    missing = [f for f in base_features if f not in out.columns]
    if missing:
        raise ValueError(f"request features cannot provide {missing}")
    return out


def abstraction(df: DataFrame) -> Column:
    """Context block of the quote."""
    return F.struct(
        c("distance_km").alias("distance_km"), c("distance_method").alias("distance_method"),
        c("day_name").alias("day_name"), c("season").alias("season"),
        (c("is_peak_month") == 1).alias("is_peak_season"),
        c("m_loaded").alias("m_loaded_kmpl"), c("m_empty").alias("m_empty_kmpl"),
        E.py_round(c("lane_popularity"), 3).alias("lane_popularity"),
        E.py_round(c("route_risk"), 3).alias("route_risk"),
        c("trip_count").alias("lane_trip_count"), c("vehicle_type").alias("vehicle_type"),
        E.py_round(c("diesel_price"), 2).alias("diesel_price"), c("diesel_source").alias("diesel_source"))


def display_derivations(df: DataFrame) -> DataFrame:
    """Values the dashboard derives from a quote."""
    pos = F.when(c("floor") < c("ceiling"),
                 (c("recommended_price") - c("floor")) / (c("ceiling") - c("floor")) * F.lit(100.0)).otherwise(F.lit(50.0))
    return (df.withColumn("delay_risk_label", E.delay_risk_label("delay_probability"))
            .withColumn("decay_hours", E.py_round(c("T_active_h"), 1) - F.lit(K.T_GRACE))
            .withColumn("corridor_position_pct", pos)
            .withColumn("corridor_marker_pct", F.least(F.lit(95.0), F.greatest(F.lit(5.0), pos)))
            .withColumn("efficiency_colour", E.score_colour("efficiency_score")))
