"""Row-level trip features and the vehicle life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.functions import expr as E
from lanecast.operators.scan import exact_quantiles, ordered_scan

def vehicle_order():
    """Order within a vehicle: trip start (NULLs last), then BookingID as tie-break."""
    return ["trip_start_date", "BookingID"]


def add_delay_hours(df: DataFrame) -> DataFrame:
    """I1 (first half) / B7: actual - planned ETA in hours; missing columns or values -> 0."""
    if "actual_eta" in df.columns and "Planned_ETA" in df.columns:
        raw = E.hours_between("Planned_ETA", "actual_eta")
    else:
        raw = F.lit(None).cast("double")
    return df.withColumn("delay_hours", F.coalesce(raw, F.lit(0.0)))


def delay_threshold(df: DataFrame, q: float) -> float:
    """Exact linear-interpolated quantile of delay_hours over all rows."""
    return exact_quantiles(df, "delay_hours", [q])[0]


def add_delay_flag(df: DataFrame, threshold: float) -> DataFrame:
    """flag = delay strictly above the threshold."""
    return df.withColumn("delay_flag", (F.col("delay_hours") > F.lit(threshold)).cast("int"))


def add_calendar(df: DataFrame) -> DataFrame:
    """H4: month, weekday (Monday = 0) and the peak-month flag from the trip start."""
    return (df.withColumn("month", F.month("trip_start_date"))
            .withColumn("day_of_week", E.weekday("trip_start_date"))
            .withColumn("is_peak_month", E.is_peak_month("month").cast("int")))


def distance_median(df: DataFrame) -> float | None:
    """D3: median of the known distances."""
    return exact_quantiles(df, "TRANSPORTATION_DISTANCE_IN_KM", [0.5])[0]


def impute_distance(df: DataFrame, median: float | None) -> DataFrame:
    """D3: missing (NULL or NaN) distance -> median."""
    if median is None:
        return df
    c = "TRANSPORTATION_DISTANCE_IN_KM"
    return df.withColumn(c, F.coalesce(E.not_nan(c), F.lit(median)))


def add_distance_features(df: DataFrame) -> DataFrame:
    """I2 distance category, I3 estimated fuel cost."""
    d = F.col("TRANSPORTATION_DISTANCE_IN_KM")
    return (df.withColumn("distance_category", E.distance_category(d))
            .withColumn("est_fuel_cost", d / F.lit(K.HIST_MILEAGE) * F.lit(K.FUEL_RATE)))


def add_market_flag(df: DataFrame, name: str = "is_market", absent_value: int = 0) -> DataFrame:
    """Booking-type flag; column absent -> constant (0 for is_market, 1 for is_regular)."""
    if "Market/Regular" in df.columns:
        return df.withColumn(name, E.market_flag(F.col("`Market/Regular`")))
    return df.withColumn(name, F.lit(absent_value))


#: Columns that follow from the others of their row (see ``add_row_features``).
ROW_FEATURES = ("delay_hours", "month", "day_of_week", "is_peak_month", "distance_category", "est_fuel_cost")


def add_row_features(df: DataFrame) -> DataFrame:
    """Delay hours, calendar and distance features of each row."""
    return add_distance_features(add_calendar(add_delay_hours(df)))


def vehicle_scan(df: DataFrame, **options) -> DataFrame:
    """E1 / E2 inputs and the global sort position (F1, E6) in one ordered scan per vehicle.

    Order within a vehicle: trip start (NULLs last), then BookingID as tie-break.
    Rows with a NULL vehicle get no next trip and no history (a grouped shift drops them).
    """
    scanned = ordered_scan(
        df, ["vehicle_no"], vehicle_order(),
        sums={"_veh_prior_flags": "delay_flag"},
        leads=["Origin_Location", "Destination_Location", "trip_start_date"],
        global_position=True, **options)
    has_vehicle = F.col("vehicle_no").isNotNull()
    nxt = F.col("_next")
    return (scanned
            .withColumn("next_origin", F.when(has_vehicle, nxt["Origin_Location"]))
            .withColumn("next_dest", F.when(has_vehicle, nxt["Destination_Location"]))
            .withColumn("next_start_time", F.when(has_vehicle, nxt["trip_start_date"]))
            .withColumn("_has_next", has_vehicle & nxt.isNotNull())
            .withColumn("_veh_prior_trips", F.when(has_vehicle, F.col("_pos")))
            .withColumn("_veh_prior_flags", F.when(has_vehicle, F.col("_veh_prior_flags")))
            .withColumnRenamed("_gpos", "sort_position")
            .drop("_next", "_pos"))


def add_trip_links(df: DataFrame) -> DataFrame:
    """I4 return trip, I5 deadhead, I6 dwell hours, I7 raw idle loss."""
    o, d = F.col("Origin_Location"), F.col("Destination_Location")
    no, nd = F.col("next_origin"), F.col("next_dest")
    is_return = F.coalesce((o == nd) & (d == no) & (o != d), F.lit(False))
    dwell_raw = E.hours_between("trip_end_date", "next_start_time")
    return (df.withColumn("is_return_trip", is_return.cast("int"))
            .withColumn("is_deadhead", (~d.eqNullSafe(no) & no.isNotNull() & ~is_return).cast("int"))
            .withColumn("dwell_time_hrs", F.when(dwell_raw.isNull(), F.lit(0.0))
                        .otherwise(F.greatest(dwell_raw, F.lit(0.0))))
            .withColumn("idle_loss_raw", F.log1p("dwell_time_hrs") * (F.col("est_fuel_cost") / 100)))


def add_driver_delay_rate(df: DataFrame, flag_mean: float) -> DataFrame:
    """Mean delay flag over the vehicle's earlier trips; none -> global mean."""
    n, s = F.col("_veh_prior_trips"), F.col("_veh_prior_flags")
    rate = F.when(n > 0, s.cast("double") / n.cast("double"))
    return df.withColumn("driver_delay_rate", F.coalesce(rate, F.lit(flag_mean)))


def dwell_threshold(df: DataFrame, q: float = 0.90) -> float:
    """max(48, quantile of dwell hours)."""
    v = exact_quantiles(df, "dwell_time_hrs", [q])[0]
    return max(K.DWELL_FLOOR_HOURS, v) if v is not None else K.DWELL_FLOOR_HOURS


def add_continuity(df: DataFrame, threshold: float) -> DataFrame:
    """I8: dwell strictly below the threshold."""
    return df.withColumn("is_continuous", F.col("dwell_time_hrs") < F.lit(threshold))
