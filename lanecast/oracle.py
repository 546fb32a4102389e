"""DuckDB SQL for the correctness oracle (tables are pre-registered views).

Each builder returns CTE text; ``__spark_entry__.oracle_sql`` selects the columns of
one query from it.  Numeric literals are written as DOUBLE casts so DuckDB does not
switch to DECIMAL arithmetic.
"""

from __future__ import annotations

from types import SimpleNamespace

from lanecast.constants import CITY_COORDS

# ---------------------------------------------------------------------------------------------
# FIXED VALUES, stated here apart from constants.py and plans/features.py: a wrong value on one
# side makes the comparison fail.  Only the city table (81 rows) is shared.
# ---------------------------------------------------------------------------------------------
V = SimpleNamespace(
    fuel_rate=87.67, hist_mileage=3.5, lam=0.062, grace=4.0, dwell_floor=48.0,
    diesel=87.67, speed=50.0, road_factor=1.32, snap_low=0.9, snap_high=1.12, t_grace=4.0, default_km=500.0,
    default_vehicle="FTL",
    vehicle={
        "LCV": {"toll": 0.8, "wage": 800, "maint": 150, "mob": 1500, "lam": 0.15},
        "MCV": {"toll": 1.6, "wage": 1000, "maint": 280, "mob": 2500, "lam": 0.1},
        "FTL": {"toll": 2.5, "wage": 1200, "maint": 400, "mob": 4500, "lam": 0.062},
        "CARTING": {"toll": 0.5, "wage": 700, "maint": 100, "mob": 800, "lam": 0.15}},
    loaded={"LCV": (12, 20, 2.5), "MCV": (6, 13, 1), "CARTING": (4, 10, 0.35), "OTHER": (2.5, 4.5, 0.06)},
    empty={"LCV": (15, 24, 2), "MCV": (8, 16, 1), "CARTING": (6, 13, 0.4), "OTHER": (3, 5.5, 0.08)},
    loaded_adjust=(0.5, 0.2, 1.5), empty_adjust=(0.5, 0.3, 2.5), long_km=500.0, short_km=150.0,
    addons={"helper_required": ("Helpers (load + unload)", 1200, None),
            "extra_tarpaulin": ("Extra Tarpaulin (Tirpal)", 500, None),
            "extra_rope": ("Extra Rope", 150, None),
            "owner_escort": ("Owner's Escort (person)", 900, None),
            "express_delivery": ("Express Delivery", None, 0.3)},
    weight_limits={"LCV": (3, 1.5), "MCV": (12, 5), "FTL": (30, 10), "CARTING": (5, 1)},
    seasons={1: "Winter", 2: "Winter", 3: "Pre-Summer", 4: "Summer", 5: "Summer", 6: "Summer", 7: "Monsoon",
             8: "Monsoon", 9: "Monsoon", 10: "Peak", 11: "Peak", 12: "Peak"})

# score weights: operations, popularity, cost, risk, driver, peak bonus, maturity cap and rate
P81 = SimpleNamespace(delay_quantile=0.8, popularity="exp", popularity_rate=0.02, risk_k=15.0, scale_on="train",
                      train_share=0.8, weights=(0.38, 0.20, 0.14, 0.14, 0.09, 0.025), maturity=(0.05, 0.005))
P725 = SimpleNamespace(delay_quantile=0.75, popularity="linear", popularity_rate=0.05, risk_k=10.0, scale_on="all",
                       train_share=0.8, weights=(0.40, 0.20, 0.15, 0.15, 0.10, 0.02), maturity=None)


def d(x) -> str:
    """A DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def city_key(x: str) -> str:
    parts = f"list_transform(string_split(coalesce({x}, 'nan'), ','), lambda p: lower({strip('p')}))"
    later = f"list_filter(list_slice({parts}, 2, 2147483647), lambda p: p <> '' AND p <> 'india')"
    return f"coalesce({later}[1], {parts}[1])"


def hours(a: str, b: str) -> str:
    return f"(CAST(datediff('microsecond', {a}, {b}) AS DOUBLE) / {d(1e6)} / {d(3600)})"


def clip01(x: str) -> str:
    return f"(CASE WHEN ({x}) < {d(0)} THEN {d(0)} WHEN ({x}) > {d(1)} THEN {d(1)} ELSE ({x}) END)"


def pyr(x: str, n: int) -> str:
    """Python round(x, n): the exact decimal expansion cut at n digits, half to even (format does that)."""
    return f"CAST(format('{{:.{n}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) < {d(lo)} THEN {d(lo)} WHEN ({x}) > {d(hi)} THEN {d(hi)} ELSE ({x}) END)"


def gmax(a: str, b: str) -> str:
    """Python max(a, b) with constant a: NULL b -> a."""
    return f"(CASE WHEN ({b}) > ({a}) THEN ({b}) ELSE ({a}) END)"


def gmin(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) < ({a}) THEN ({b}) ELSE ({a}) END)"


def trips_sql() -> str:
    end = "(l_shipdate + to_hours(3 * l_linenumber) + to_hours(CAST(ceil(l_extendedprice / 5000) AS BIGINT)))"
    late = "CAST(round(l_discount * 100) + round(l_tax * 100) - 9 AS BIGINT)"
    veh = "CAST(l_partkey // 10 AS VARCHAR)"
    return f"""
place AS (
  SELECT n_nationkey, n_name || ', ' || r_name || ', India' AS place, r_name
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
trips_raw AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS BookingID,
    'V' || lpad({veh}, CAST(greatest(6, length({veh})) AS INTEGER), '0') AS vehicle_no,
    sp.place AS Origin_Location,
    CASE WHEN l_orderkey % 499 = 0 THEN 'HARBOUR, HARBOUR, India' ELSE cp.place END AS Destination_Location,
    CASE WHEN sp.r_name = 'AFRICA' AND cp.r_name = 'EUROPE' THEN {d(0)} WHEN l_linenumber = 7 AND l_quantity <= 5 THEN NULL ELSE l_extendedprice / {d(100)} END
      AS TRANSPORTATION_DISTANCE_IN_KM,
    l_shipdate + to_hours(3 * l_linenumber) AS trip_start_date,
    {end} AS trip_end_date,
    {end} AS Planned_ETA,
    CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL ELSE {end} + to_hours({late}) END AS actual_eta,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'Regular '
         WHEN substr(o_orderpriority, 1, 1) = '4' THEN NULL ELSE 'Market' END AS "Market/Regular"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN place sp ON s_nationkey = sp.n_nationkey
  JOIN customer ON o_custkey = c_custkey
  JOIN place cp ON c_nationkey = cp.n_nationkey
)"""


def features_sql(p=P81) -> str:
    """CTE chain: trips_raw -> f_prep -> f_veh -> f_lane -> f_scaled -> f_eff -> features."""
    w = p.weights
    veh_w = "PARTITION BY vehicle_no ORDER BY trip_start_date ASC NULLS LAST, BookingID ASC NULLS LAST"
    lane_o = "vehicle_no ASC NULLS LAST, trip_start_date ASC NULLS LAST, BookingID ASC NULLS LAST"
    lane_w = f"PARTITION BY Origin_Location, Destination_Location ORDER BY {lane_o}"
    prior = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    rc = "CAST(route_count AS DOUBLE)"
    if p.popularity == "exp":
        boost = f"exp({d(p.popularity_rate)} * {rc})"
    else:
        boost = f"({d(1)} + {d(p.popularity_rate)} * {rc})"
    std = "coalesce(lp_std, 0)"
    fit = "WHERE is_train" if p.scale_on == "train" else ""
    train = (f"sort_position < CAST(floor(CAST(n AS DOUBLE) * {d(p.train_share)}) AS BIGINT)"
             if p.scale_on == "train" else "true")
    eps = d(10 * 2.220446049250313e-16)

    def scale(c):
        return (f"{c} * (1.0::DOUBLE / CASE WHEN (max_{c} - min_{c}) < {eps} THEN 1.0::DOUBLE ELSE (max_{c} - min_{c}) END)"
                f" + (0.0::DOUBLE - min_{c} * (1.0::DOUBLE / CASE WHEN (max_{c} - min_{c}) < {eps} THEN 1.0::DOUBLE"
                f" ELSE (max_{c} - min_{c}) END))")

    fallback = (f"({d(0.30)} + {d(0.30)} * lane_popularity + {d(0.20)} * cost_weight"
                f" + {d(0.20)} * ({d(1)} - risk_score))")
    adj = f"({d(V.lam)} / {gmax(d(1), f'ln(1 + TRANSPORTATION_DISTANCE_IN_KM / {d(100)})')})"
    t_adj = gmax(d(0), f"dwell_time_hrs - {d(V.grace)}")
    ops0 = f"(exp(-{adj} * {t_adj}) * ({d(0.7)} + {d(0.3)} * dist_norm))"
    ops = (f"(CASE WHEN is_return_trip = 1 THEN {gmin(d(1), f'{ops0} * {d(1.5)}')}"
           f" WHEN is_deadhead = 1 THEN {ops0} * {d(0.35)} ELSE {ops0} END)")
    score = (f"({ops} * {d(w[0])} + lane_popularity * {d(w[1])} + cost_weight * {d(w[2])}"
             f" + ({d(1)} - risk_score) * {d(w[3])} + ({d(1)} - driver_delay_rate) * {d(w[4])})")
    if p.maturity:
        score = f"({score} + {gmin(d(p.maturity[0]), f'lane_maturity * {d(p.maturity[1])}')})"
    score = f"(CASE WHEN is_peak_month = 1 THEN {score} + {d(w[5])} ELSE {score} END)"
    eff = (f"round_even({clip01(f'CASE WHEN next_start_time IS NULL OR NOT is_continuous THEN {fallback} ELSE {score} END')}, 4)")
    dwell_raw = hours("trip_end_date", "next_start_time")
    return f"""{trips_sql()},
f_base AS (
  SELECT *, coalesce({hours('Planned_ETA', 'actual_eta')}, {d(0)}) AS delay_hours FROM trips_raw
),
f_s1 AS (
  SELECT quantile_cont(delay_hours, {d(p.delay_quantile)}) AS thr,
         quantile_cont(TRANSPORTATION_DISTANCE_IN_KM, {d(0.5)}) AS med
  FROM f_base
),
f_prep AS (
  SELECT b.* REPLACE (coalesce(b.TRANSPORTATION_DISTANCE_IN_KM, s.med) AS TRANSPORTATION_DISTANCE_IN_KM),
    CAST(b.delay_hours > s.thr AS INTEGER) AS delay_flag,
    month(b.trip_start_date) AS month,
    isodow(b.trip_start_date) - 1 AS day_of_week,
    CAST(coalesce(month(b.trip_start_date) IN (10, 11, 12), false) AS INTEGER) AS is_peak_month
  FROM f_base b, f_s1 s
),
f_prep2 AS (
  SELECT *,
    CASE WHEN TRANSPORTATION_DISTANCE_IN_KM < 200 THEN 0 WHEN TRANSPORTATION_DISTANCE_IN_KM < 500 THEN 1 ELSE 2 END
      AS distance_category,
    TRANSPORTATION_DISTANCE_IN_KM / {d(V.hist_mileage)} * {d(V.fuel_rate)} AS est_fuel_cost
  FROM f_prep
),
f_veh AS (
  SELECT *,
    CASE WHEN vehicle_no IS NOT NULL THEN lead(Origin_Location) OVER ({veh_w}) END AS next_origin,
    CASE WHEN vehicle_no IS NOT NULL THEN lead(Destination_Location) OVER ({veh_w}) END AS next_dest,
    CASE WHEN vehicle_no IS NOT NULL THEN lead(trip_start_date) OVER ({veh_w}) END AS next_start_time,
    CASE WHEN vehicle_no IS NOT NULL THEN row_number() OVER ({veh_w}) - 1 END AS veh_prior_trips,
    CASE WHEN vehicle_no IS NOT NULL THEN coalesce(sum(delay_flag) OVER ({veh_w} {prior}), 0) END AS veh_prior_flags,
    row_number() OVER (ORDER BY vehicle_no ASC NULLS LAST, trip_start_date ASC NULLS LAST, BookingID ASC NULLS LAST) - 1
      AS sort_position
  FROM f_prep2
),
f_links AS (
  SELECT *,
    CAST(coalesce(Origin_Location = next_dest AND Destination_Location = next_origin
                  AND Origin_Location <> Destination_Location, false) AS INTEGER) AS is_return_trip,
    CASE WHEN {dwell_raw} IS NULL THEN {d(0)} ELSE {gmax(d(0), dwell_raw)} END AS dwell_time_hrs
  FROM f_veh
),
f_links2 AS (
  SELECT *,
    CAST(NOT (Destination_Location IS NOT DISTINCT FROM next_origin) AND next_origin IS NOT NULL
         AND is_return_trip = 0 AS INTEGER) AS is_deadhead,
    ln(1 + dwell_time_hrs) * (est_fuel_cost / {d(100)}) AS idle_loss_raw
  FROM f_links
),
f_lane0 AS (
  SELECT *,
    CASE WHEN Origin_Location IS NOT NULL AND Destination_Location IS NOT NULL
         THEN row_number() OVER ({lane_w}) - 1 END AS route_count,
    CASE WHEN Origin_Location IS NOT NULL AND Destination_Location IS NOT NULL
         THEN count(BookingID) OVER ({lane_w} {prior}) END AS lp_bookings,
    CASE WHEN Origin_Location IS NOT NULL AND Destination_Location IS NOT NULL
         THEN stddev_samp(delay_flag) OVER ({lane_w} {prior}) END AS lp_std
  FROM f_links2
),
f_lane AS (
  SELECT *,
    ln(1 + {rc}) AS lane_maturity,
    coalesce(CAST(lp_bookings AS DOUBLE), {d(0)}) * {boost} + {d(1)} AS lane_popularity_raw,
    {std} AS route_risk_raw,
    {std} * ({rc} / ({rc} + {d(p.risk_k)})) AS route_risk_smoothed
  FROM f_lane0
),
f_lane2 AS (
  SELECT *,
    ln(1 + lane_popularity_raw) AS lane_popularity_log,
    {d(1)} / ({d(1)} + ln(1 + est_fuel_cost / {d(1000)})) AS cost_weight_raw
  FROM f_lane
),
f_s2 AS (
  SELECT count(*) AS n, avg(delay_flag) AS flag_mean,
         greatest({d(V.dwell_floor)}, quantile_cont(dwell_time_hrs, {d(0.9)})) AS dwell_thr
  FROM f_lane2
),
f_split AS (
  SELECT l.*,
    coalesce(CASE WHEN veh_prior_trips > 0 THEN CAST(veh_prior_flags AS DOUBLE) / CAST(veh_prior_trips AS DOUBLE) END,
             s.flag_mean) AS driver_delay_rate,
    l.dwell_time_hrs < s.dwell_thr AS is_continuous,
    {train} AS is_train
  FROM f_lane2 l, f_s2 s
),
f_fit AS (
  SELECT min(lane_popularity_log) AS min_lane_popularity_log, max(lane_popularity_log) AS max_lane_popularity_log,
         min(cost_weight_raw) AS min_cost_weight_raw, max(cost_weight_raw) AS max_cost_weight_raw,
         min(idle_loss_raw) AS min_idle_loss_raw, max(idle_loss_raw) AS max_idle_loss_raw,
         min(route_risk_smoothed) AS min_route_risk_smoothed, max(route_risk_smoothed) AS max_route_risk_smoothed,
         max(TRANSPORTATION_DISTANCE_IN_KM) AS max_dist
  FROM f_split {fit}
),
f_scaled AS (
  SELECT s.*,
    {scale('lane_popularity_log')} AS lane_popularity,
    {scale('cost_weight_raw')} AS cost_weight,
    {scale('idle_loss_raw')} AS idle_loss,
    {scale('route_risk_smoothed')} AS route_risk,
    TRANSPORTATION_DISTANCE_IN_KM / max_dist AS dist_norm
  FROM f_split s, f_fit
),
f_risk AS (
  SELECT *,
    {d(1)} - route_risk AS confidence_score,
    {d(0.15)} * delay_flag + {d(0.20)} * dist_norm + {d(0.30)} * ({d(1)} - lane_popularity)
      + {d(0.35)} * route_risk AS risk_score_raw
  FROM f_scaled
),
f_rfit AS (
  SELECT min(risk_score_raw) AS min_risk_score_raw, max(risk_score_raw) AS max_risk_score_raw FROM f_risk {fit}
),
f_eff AS (
  SELECT r.*, {scale('risk_score_raw')} AS risk_score FROM f_risk r, f_rfit
),
f_eff2 AS (
  SELECT *, {eff} AS efficiency_score FROM f_eff
),
f_edges AS (
  SELECT quantile_cont(efficiency_score, {d(1.0 / 3.0)}) AS e1,
         quantile_cont(efficiency_score, {d(2.0 / 3.0)}) AS e2
  FROM f_eff2
),
features AS (
  SELECT f.*,
    CASE WHEN efficiency_score IS NULL THEN NULL WHEN efficiency_score <= e1 THEN 'Low'
         WHEN efficiency_score <= e2 THEN 'Medium' ELSE 'High' END AS efficiency_label,
    CAST(coalesce({strip('"Market/Regular"')} = 'Regular', false) AS INTEGER) AS is_market
  FROM f_eff2 f, f_edges
)"""


# ---------------------------------------------------------------------------------------------
# requests and quotes
# ---------------------------------------------------------------------------------------------

def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def requests_sql() -> str:
    return f"""
req_raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS request_id,
    CASE WHEN o_orderkey % 83 = 0 THEN 'X' WHEN o_orderkey % 79 = 0 THEN repeat('Long', 31) ELSE
      CASE o_orderkey % 4 WHEN 0 THEN ' ' || r_name || ' ' WHEN 1 THEN substr(r_name, 1, 4)
      WHEN 2 THEN {_list(['Delhi', 'Mumbai', 'Pune', 'Bengaluru', 'Kochi'])}[o_custkey % 5 + 1] ELSE 'Nowhere' END END AS origin,
    CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 7 = 0 THEN 'HARBOUR' ELSE {_list(['ASIA', 'EUROPE', 'AFRICA'])}[o_custkey % 3 + 1] END WHEN 1 THEN 'EUR'
      WHEN 2 THEN {_list(['Jaipur', 'Surat', 'Salem'])}[o_custkey % 3 + 1] ELSE 'Elsewhere' END AS destination,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS trip_date,
    CAST(o_orderkey % 52 AS DOUBLE) AS weight_tonnes,
    CASE WHEN o_orderkey % 26 = 0 THEN 'Carting' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lcv' WHEN '2' THEN ' MCV ' WHEN '3' THEN 'FTL'
      WHEN '5' THEN 'CARTING' END END AS vehicle_type,
    CASE WHEN o_orderkey % 103 = 0 THEN {d(0)} WHEN o_orderstatus = 'F' THEN o_totalprice / {d(5)} END AS competitor_price,
    CASE WHEN o_orderkey % 17 = 0 THEN {d(250)} WHEN o_orderkey % 13 = 0 THEN {d(200)}
      WHEN o_orderstatus = 'P' THEN {d(95.5)} END AS diesel_price,
    CASE o_orderkey % 3 WHEN 1 THEN ['extra_rope', 'extra_rope', 'unknown']
      WHEN 2 THEN ['helper_required', 'express_delivery'] END AS addons,
    CASE WHEN o_orderkey % 101 = 0 THEN {d(95)} WHEN o_orderkey % 5 = 1 OR o_orderkey % 13 = 0
      THEN {d(8)} + CAST(o_custkey % 2900 AS DOUBLE) / {d(100)} END AS origin_lat,
    CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 13 = 0 THEN {d(68)} + CAST(o_orderkey % 2900 AS DOUBLE) / {d(100)} END AS origin_lon,
    CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 13 = 0 THEN {d(8)} + CAST(o_orderkey % 2800 AS DOUBLE) / {d(100)} END AS dest_lat,
    CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 13 = 0 THEN {d(68)} + CAST(o_custkey % 2800 AS DOUBLE) / {d(100)} END AS dest_lon,
    CASE WHEN o_orderkey % 13 = 0 THEN {d(0)} ELSE CAST(o_orderkey % 101 AS DOUBLE) / {d(100)} END AS p_delay,
    CASE WHEN o_orderkey % 13 = 0 THEN {d(1)} ELSE CAST(o_custkey % 101 AS DOUBLE) / {d(100)} END AS eff,
    o_orderkey, o_custkey, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def road_sql() -> str:
    """Road distances: request coordinates of a third of the orders (some twice, some 0), and one pair of cities."""
    xy = "origin_lat AS lat1, origin_lon AS lon1, dest_lat AS lat2, dest_lon AS lon2"
    (a, b), (c, e) = CITY_COORDS["delhi"], CITY_COORDS["jaipur"]
    return f"""
road AS (
  SELECT {xy}, CASE WHEN o_orderkey % 7 = 0 THEN {d(0)} WHEN o_orderkey % 13 = 0 THEN o_totalprice / {d(20)}
      ELSE o_totalprice / {d(100)} END AS km
    FROM req_raw WHERE o_orderkey % 5 = 1 AND o_orderkey % 3 = 0 OR o_orderkey % 13 = 0
  UNION ALL SELECT {xy}, {d(0)} FROM req_raw WHERE o_orderkey % 5 = 1 AND o_orderkey % 6 = 0
  UNION ALL SELECT {d(a)}, {d(b)}, {d(c)}, {d(e)}, {d(100)} + o_totalprice / {d(1000)} FROM req_raw
    WHERE o_orderkey % 4 = 2 AND o_custkey % 15 = 0
),
road_km AS (
  SELECT round(lat1, 4) AS r1, round(lon1, 4) AS r2, round(lat2, 4) AS r3, round(lon2, 4) AS r4, min(km) AS km
  FROM road WHERE km <> 0 GROUP BY 1, 2, 3, 4
)"""


DATE_RE = r"^(\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])$"


def trip_day(x: str) -> str:
    norm = (f"regexp_extract({x}, '{DATE_RE}', 1) || '-' || lpad(trim(regexp_extract({x}, '{DATE_RE}', 2)), 2, '0')"
            f" || '-' || lpad(trim(regexp_extract({x}, '{DATE_RE}', 3)), 2, '0')")
    return f"(CASE WHEN regexp_full_match({x}, '{DATE_RE}') THEN CAST(try_strptime({norm}, '%Y-%m-%d') AS DATE) END)"


def reasons_sql() -> str:
    def ln(f):
        return [f"CASE WHEN {f} IS NULL THEN '{f}: Field required' END",
                f"CASE WHEN length({f}) < 2 THEN '{f}: String should have at least 2 characters' END",
                f"CASE WHEN length({f}) > 120 THEN '{f}: String should have at most 120 characters' END",
                f"CASE WHEN {f} IS NOT NULL AND length({f}) >= 2 AND length({strip(f)}) = 0 THEN '{f}: blank' END"]

    def rng(f, gt=None, ge=None, le=None, required=False):
        out = []
        if required:
            out.append(f"CASE WHEN {f} IS NULL THEN '{f}: Field required' END")
        if gt is not None:
            out.append(f"CASE WHEN {f} <= {gt} THEN '{f}: Input should be greater than {gt}' END")
        if ge is not None:
            out.append(f"CASE WHEN {f} < {ge} THEN '{f}: Input should be greater than or equal to {ge}' END")
        if le is not None:
            out.append(f"CASE WHEN {f} > {le} THEN '{f}: Input should be less than or equal to {le}' END")
        return out
    checks = (ln("origin") + ln("destination")
              + ["CASE WHEN trip_date IS NULL THEN 'trip_date: Field required' END",
                 f"CASE WHEN trip_date IS NOT NULL AND {trip_day('trip_date')} IS NULL THEN "
                 "'trip_date: Value error, trip_date must be in YYYY-MM-DD format' END"]
              + rng("weight_tonnes", gt=0, le=50, required=True) + rng("competitor_price", gt=0)
              + rng("diesel_price", gt=0, le=200) + rng("origin_lat", ge=-90, le=90) + rng("origin_lon", ge=-180, le=180)
              + rng("dest_lat", ge=-90, le=90) + rng("dest_lon", ge=-180, le=180))
    return f"list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL)"


def _gaz_values() -> str:
    return ", ".join(f"('{c}', {d(lat)}, {d(lon)})" for c, (lat, lon) in CITY_COORDS.items())


def _veh_case(vt: str, attr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {d(v[attr])}" for k, v in V.vehicle.items())
    return f"(CASE {vt} {whens} END)"


def _mileage_sql(curves, adjust, w, vt, km) -> str:
    def curve(name):
        floor, icpt, slope = curves[name]
        return gmax(d(floor), f"{d(icpt)} - {d(slope)} * {w}")
    base = (f"(CASE WHEN {vt} = 'LCV' THEN {curve('LCV')} WHEN {vt} = 'MCV' THEN {curve('MCV')} "
            f"WHEN {vt} = 'CARTING' THEN {curve('CARTING')} ELSE {curve('OTHER')} END)")
    bonus, pen, floor = adjust
    adj = (f"(CASE WHEN {km} > {d(V.long_km)} THEN {base} + {d(bonus)} "
           f"WHEN {km} < {d(V.short_km)} THEN {base} - {d(pen)} ELSE {base} END)")
    return pyr(gmax(d(floor), adj), 2)


def quotes_sql() -> str:
    """CTE chain: req_raw -> q_valid -> q_lane -> q_dist -> q_ret -> q_price -> quotes."""
    seasons = " ".join(f"WHEN {m} THEN '{s}'" for m, s in V.seasons.items())
    hav = (f"({d(6371)} * 2 * asin(sqrt(pow(sin(radians(g2.lat - g1.lat) / 2), 2) + cos(radians(g1.lat)) * "
           f"cos(radians(g2.lat)) * pow(sin(radians(g2.lon - g1.lon) / 2), 2))) * {d(V.road_factor)})")
    h = "(CAST(hour(arrival) AS DOUBLE) + CAST(minute(arrival) AS DOUBLE) / 60.0::DOUBLE)"
    eff_ = (f"(CASE WHEN {h} < 8.0::DOUBLE THEN {gmax(d(0), f'expected_dwell_h - (8.0::DOUBLE - {h})')}"
            f" WHEN {h} >= 20.0::DOUBLE THEN {gmax(d(0), f'expected_dwell_h - ((24.0::DOUBLE - {h}) + 8.0::DOUBLE)')}"
            f" ELSE expected_dwell_h END)")
    rem = f"(CASE WHEN {h} < 8.0::DOUBLE OR {h} >= 20.0::DOUBLE THEN 12.0::DOUBLE ELSE 20.0::DOUBLE - {h} END)"
    t_active = f"(CASE WHEN {eff_} <= {rem} THEN {eff_} ELSE {rem} + ({eff_} - {rem}) * {d(0.5)} END)"
    known = _list(V.addons)
    amount = ("(CASE k " + " ".join(f"WHEN '{a}' THEN CAST({cost} AS BIGINT)" for a, (_, cost, _) in V.addons.items()
                                    if cost is not None)
              + " " + " ".join(f"WHEN '{a}' THEN CAST({pyr(f'rp * {d(pct)}', 0)} AS BIGINT)"
                               for a, (_, _, pct) in V.addons.items() if pct is not None) + " END)")
    vt = "vehicle_type"
    return f"""{features_sql(P81)},
kb AS (SELECT {city_key('Origin_Location')} AS ok, {city_key('Destination_Location')} AS dk,
         avg(lane_popularity) AS lane_popularity, avg(route_risk) AS route_risk,
         avg(driver_delay_rate) AS driver_delay_rate, count(*) AS trip_count,
         avg(TRANSPORTATION_DISTANCE_IN_KM) AS avg_dist_km
       FROM features GROUP BY 1, 2),
kb_global AS (SELECT avg(lane_popularity) AS lane_popularity, avg(route_risk) AS route_risk,
         avg(driver_delay_rate) AS driver_delay_rate, CAST(0 AS BIGINT) AS trip_count,
         avg(TRANSPORTATION_DISTANCE_IN_KM) AS avg_dist_km FROM features),
gaz(city, lat, lon) AS (VALUES {_gaz_values()}),
{requests_sql().strip()},
{road_sql().strip()},
q_checked AS (SELECT *, {reasons_sql()} AS reasons FROM req_raw),
q_valid AS (
  SELECT request_id, {strip('origin')} AS origin, {strip('destination')} AS destination, trip_date,
    {trip_day('trip_date')} AS trip_day, weight_tonnes,
    CASE WHEN upper({strip(f"CASE WHEN {vt} IS NULL OR {vt} = '' THEN 'FTL' ELSE {vt} END")}) IN {tuple(V.vehicle)}
         THEN upper({strip(f"CASE WHEN {vt} IS NULL OR {vt} = '' THEN 'FTL' ELSE {vt} END")}) ELSE 'FTL' END AS vehicle_type,
    competitor_price,
    CASE WHEN diesel_price IS NOT NULL AND diesel_price <> 0 THEN diesel_price ELSE {d(V.diesel)} END AS diesel_price,
    CASE WHEN diesel_price IS NOT NULL AND diesel_price <> 0 THEN 'vision' ELSE 'default' END AS diesel_source,
    list_filter(coalesce(addons, CAST([] AS VARCHAR[])), lambda x: list_contains({known}, x)) AS addons,
    origin_lat, origin_lon, dest_lat, dest_lon, p_delay, eff
  FROM q_checked WHERE len(reasons) = 0
),
q_keys AS (SELECT *, lower({strip('origin')}) AS q_ok, lower({strip('destination')}) AS q_dk FROM q_valid),
q_miss AS (
  SELECT DISTINCT q.q_ok, q.q_dk FROM q_keys q LEFT JOIN kb ON q.q_ok = kb.ok AND q.q_dk = kb.dk WHERE kb.ok IS NULL
),
q_contains AS (
  SELECT q_ok, q_dk, lane_popularity, route_risk, driver_delay_rate, trip_count, avg_dist_km FROM (
    SELECT m.q_ok, m.q_dk, kb.*, row_number() OVER (PARTITION BY m.q_ok, m.q_dk ORDER BY kb.ok, kb.dk) AS rn
    FROM q_miss m JOIN kb ON contains(kb.ok, m.q_ok) AND contains(kb.dk, m.q_dk)) WHERE rn = 1
),
q_lane AS (
  SELECT q.*,
    CASE WHEN x.ok IS NOT NULL THEN 'exact' WHEN c.q_ok IS NOT NULL THEN 'contains' ELSE 'global' END AS lane_match,
    CASE WHEN x.ok IS NOT NULL THEN x.lane_popularity WHEN c.q_ok IS NOT NULL THEN c.lane_popularity ELSE g.lane_popularity END AS lane_popularity,
    CASE WHEN x.ok IS NOT NULL THEN x.route_risk WHEN c.q_ok IS NOT NULL THEN c.route_risk ELSE g.route_risk END AS route_risk,
    CASE WHEN x.ok IS NOT NULL THEN x.driver_delay_rate WHEN c.q_ok IS NOT NULL THEN c.driver_delay_rate ELSE g.driver_delay_rate END AS driver_delay_rate,
    CASE WHEN x.ok IS NOT NULL THEN x.trip_count WHEN c.q_ok IS NOT NULL THEN c.trip_count ELSE g.trip_count END AS trip_count,
    CASE WHEN x.ok IS NOT NULL THEN x.avg_dist_km WHEN c.q_ok IS NOT NULL THEN c.avg_dist_km ELSE g.avg_dist_km END AS avg_dist_km
  FROM q_keys q LEFT JOIN kb x ON q.q_ok = x.ok AND q.q_dk = x.dk
  LEFT JOIN q_contains c ON q.q_ok = c.q_ok AND q.q_dk = c.q_dk
  CROSS JOIN kb_global g
),
q_dist AS (
  SELECT q.*,
    isodow(trip_day) - 1 AS day_of_week, month(trip_day) AS month,
    CASE month(trip_day) {seasons} END AS season,
    CAST(month(trip_day) IN (10, 11, 12) AS INTEGER) AS is_peak_month,
    strftime(trip_day, '%A') AS day_name, strftime(trip_day, '%d %b %Y') AS formatted_date,
    CASE WHEN rq.km IS NOT NULL THEN {pyr("rq.km", 1)} WHEN rg.km IS NOT NULL THEN {pyr("rg.km", 1)}
         WHEN g1.lat IS NOT NULL AND g2.lat IS NOT NULL THEN {pyr(hav, 1)}
         WHEN avg_dist_km > 0 THEN {pyr("avg_dist_km", 1)} ELSE {d(V.default_km)} END AS distance_km,
    CASE WHEN rq.km IS NOT NULL OR rg.km IS NOT NULL THEN 'osrm'
         WHEN g1.lat IS NOT NULL AND g2.lat IS NOT NULL THEN 'haversine'
         WHEN avg_dist_km > 0 THEN 'historical_avg' ELSE 'default_fallback' END AS distance_method,
    p_delay AS delay_probability, {clip01('eff')} AS efficiency_score
  FROM q_lane q LEFT JOIN gaz g1 ON lower({strip('q.origin')}) = g1.city
  LEFT JOIN gaz g2 ON lower({strip('q.destination')}) = g2.city
  LEFT JOIN road_km rq ON round(q.origin_lat, 4) = rq.r1 AND round(q.origin_lon, 4) = rq.r2
    AND round(q.dest_lat, 4) = rq.r3 AND round(q.dest_lon, 4) = rq.r4
  LEFT JOIN road_km rg ON round(g1.lat, 4) = rg.r1 AND round(g1.lon, 4) = rg.r2
    AND round(g2.lat, 4) = rg.r3 AND round(g2.lon, 4) = rg.r4
),
q_ret0 AS (
  SELECT *,
    CAST(trip_day AS TIMESTAMP) + INTERVAL 6 HOUR
      + to_microseconds(CAST(round_even(distance_km / {d(V.speed)} * {d(3.6e9)}, 0) AS BIGINT)) AS arrival,
    {d(V.t_grace)} + ({d(1)} - lane_popularity) * {d(20)} AS expected_dwell_h,
    {_veh_case(vt, 'lam')} AS lam,
    {_mileage_sql(V.loaded, V.loaded_adjust, 'weight_tonnes', vt, 'distance_km')} AS m_loaded,
    {_mileage_sql(V.empty, V.empty_adjust, 'weight_tonnes', vt, 'distance_km')} AS m_empty
  FROM q_dist
),
q_ret AS (
  SELECT *, {t_active} AS T_active_raw, strftime(arrival, '%H:%M, %a') AS arrival_time FROM q_ret0
),
q_ret2 AS (
  SELECT *,
    {clip(f"exp(-lam * {gmax(d(0), f'T_active_raw - {d(V.t_grace)}')})", 0.05, 0.99)} AS p_return,
    {pyr("T_active_raw", 1)} AS T_active_h,
    (CASE WHEN trip_count / {d(50)} < {d(1)} THEN trip_count / {d(50)} ELSE {d(1)} END) * {d(0.55)}
      + ({d(0.5)} + abs(efficiency_score - {d(0.5)}) * {d(0.8)}) * {d(0.35)}
      - CASE WHEN distance_method IN ('historical_avg', 'osrm') THEN {d(0)} ELSE {d(0.08)} END AS conf_raw0
  FROM q_ret
),
q_conf AS (
  SELECT *,
    CASE WHEN conf_raw0 < {d(0.10)} THEN {d(0.10)} WHEN conf_raw0 > {d(0.97)} THEN {d(0.97)} ELSE conf_raw0 END AS conf_raw
  FROM q_ret2
),
q_p1 AS (
  SELECT *,
    {pyr("conf_raw", 3)} AS confidence_score,
    CASE WHEN conf_raw >= {d(0.82)} THEN 'Elite' WHEN conf_raw >= {d(0.62)} THEN 'High' WHEN conf_raw >= {d(0.42)} THEN 'Moderate' ELSE 'Low' END
      AS confidence_label,
    CASE WHEN efficiency_score >= {d(0.85)} THEN 'Elite' WHEN efficiency_score >= {d(0.65)} THEN 'High'
         WHEN efficiency_score >= {d(0.35)} THEN 'Medium' ELSE 'Low' END AS efficiency_label,
    distance_km / m_loaded * diesel_price AS fuel_loaded_cost,
    distance_km / m_empty * diesel_price AS fuel_empty_cost,
    {d(2)} * distance_km * {_veh_case(vt, 'toll')} AS tolls,
    distance_km * {d(2)} / {d(V.speed)} / {d(24)} * {_veh_case(vt, 'wage')} AS wages,
    distance_km * {d(2)} / {d(V.speed)} / {d(24)} * {_veh_case(vt, 'maint')} AS maintenance,
    {_veh_case(vt, 'mob')} AS mobilization,
    {_veh_case(vt, 'toll')} AS toll
  FROM q_conf
),
q_p2 AS (
  SELECT *,
    fuel_loaded_cost + tolls + wages + maintenance + mobilization AS c_base,
    ({d(1)} - p_return) * fuel_empty_cost AS c_risk,
    {d(1)} + delay_probability * {d(0.10)} + ({d(0.5)} - efficiency_score) * {d(0.08)} AS mult0
  FROM q_p1
),
q_p3 AS (
  SELECT *, {pyr(f"(c_base + c_risk) * {clip('mult0', 0.95, 1.15)}", 2)} AS p_min
  FROM q_p2
),
q_p4 AS (SELECT *, {pyr(f"p_min * {d(1.15)}", 2)} AS p_max FROM q_p3),
q_p5 AS (
  SELECT *,
    CASE WHEN competitor_price IS NOT NULL AND competitor_price > 0
         THEN greatest(p_min, competitor_price * {d(V.snap_low)}) ELSE p_min END AS floor,
    CASE WHEN competitor_price IS NOT NULL AND competitor_price > 0
         THEN least(p_max, competitor_price * {d(V.snap_high)}) ELSE p_max END AS ceil0,
    fuel_loaded_cost + distance_km * toll + {d(0.80)} * wages AS c_survival
  FROM q_p4
),
q_p6 AS (
  SELECT *, CASE WHEN floor > ceil0 THEN floor ELSE ceil0 END AS ceiling, floor >= c_survival AS is_feasible,
    CASE WHEN floor >= c_survival THEN floor ELSE c_survival END AS recommended
  FROM q_p5
),
q_p7 AS (
  SELECT *,
    CASE WHEN recommended < c_survival THEN 'Infeasible'
         WHEN (CASE WHEN c_base > 0 THEN (recommended - c_survival) / c_base ELSE {d(0)} END) >= {d(0.10)} THEN 'Healthy'
         ELSE 'Low Margin' END AS status,
    {pyr("recommended", 2)} AS rp
  FROM q_p6
),
quotes AS (
  SELECT *,
    coalesce(list_sum(list_transform(addons, lambda k: {amount})), 0) AS addon_total,
    rp AS recommended_price
  FROM q_p7
),
quotes2 AS (
  SELECT *, CAST({pyr("rp + CAST(addon_total AS DOUBLE)", 0)} AS BIGINT) AS final_price FROM quotes
)"""
