"""Static dimensions (A7, A8, F2): gazetteer, vehicle classes, add-ons, seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast import constants as K


def gazetteer(spark: SparkSession) -> DataFrame:
    """City -> (lat, lon); fixed size (81 rows), safe to broadcast."""
    rows = [(c, lat, lon) for c, (lat, lon) in K.CITY_COORDS.items()]
    return spark.createDataFrame(rows, "city string, lat double, lon double")


def city_list(spark: SparkSession) -> DataFrame:
    """sorted distinct title-cased city names."""
    return gazetteer(spark).select(F.initcap("city").alias("city")).distinct().orderBy("city")


def vehicle_attr(vehicle: Column, attr: str) -> Column:
    """C5 as a map literal: vehicle class -> attribute (classes are already normalised)."""
    m = F.create_map(*[x for k, v in K.VEHICLE_CONFIG.items() for x in (F.lit(k), F.lit(float(v[attr])))])
    return F.coalesce(m[vehicle], F.lit(float(K.VEHICLE_CONFIG[K.DEFAULT_VEHICLE][attr])))
