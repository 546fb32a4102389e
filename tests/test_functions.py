import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecast.functions import expr as E


def test_city_key_edge_rows(spark):
    rows = [(" Foo , Bar, India",), ("Solo",), ("X, India, , Kerala",), ("India, India",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(E.city_key("a")).collect()]
    assert got == ["bar", "solo", "kerala", "india", "nan"]


def test_place_key_strips_all_white_space(spark):
    df = spark.createDataFrame([("\t Delhi \n",), ("  MUMBAI",)], "a string")
    assert [r[0] for r in df.select(E.place_key("a")).collect()] == ["delhi", "mumbai"]


def test_py_round_matches_python_round(spark):
    random.seed(7)
    xs = [round(random.uniform(0, 100000), 3) for _ in range(3000)]
    xs += [2.675, 19844.975, 0.125, 0.375, 1.005, 76619.5, 2.5, 3.5, -2.5, 1234.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 3):
        got = [r[0] for r in df.select(E.py_round("x", n)).collect()]
        want = [float(round(x, n)) for x in xs]
        assert got == want, n


def test_round_even_matches_numpy(spark):
    random.seed(3)
    xs = [random.uniform(0, 1) for _ in range(2000)] + [0.12345, 0.00005, 0.99995]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(E.round_even("x", 4)).collect()]
    assert got == [float(np.round(x, 4)) for x in xs]


def test_haversine_matches_formula(spark):
    def hav(a, b, c, d):
        dlat, dlon = math.radians(c - a), math.radians(d - b)
        h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(dlon / 2) ** 2
        return 6371.0 * 2 * math.asin(math.sqrt(h))
    pts = (28.6139, 77.2090, 19.0760, 72.8777)
    got = spark.createDataFrame([pts], "a double, b double, c double, d double") \
        .select(E.haversine_km("a", "b", "c", "d")).first()[0]
    assert got == pytest.approx(hav(*pts), rel=1e-12)
    assert round(got * 1.32, 1) == 1515.5


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(E.clip("x", 0.0, 1.0)).collect()] == [None, 0.0, 1.0, 0.5]


def test_calendar_and_season(spark):
    df = spark.createDataFrame([("2026-05-01",), ("2026-03-02",), ("2026-12-31",)], "d string") \
        .select(F.to_date("d").alias("d"))
    out = df.select(E.weekday("d").alias("w"), E.season(F.month("d")).alias("s")).collect()
    assert [(r.w, r.s) for r in out] == [(4, "Summer"), (0, "Pre-Summer"), (3, "Peak")]


def test_distance_category_bounds(spark):
    df = spark.createDataFrame([(199.99,), (200.0,), (499.9,), (500.0,), (None,)], "k double")
    assert [r[0] for r in df.select(E.distance_category("k")).collect()] == [0, 1, 1, 2, 2]


def test_strip_unicode_white_space(spark):
    text = " 　 Pune\t "
    got = spark.createDataFrame([(text,)], "a string").select(E.strip("a")).first()[0]
    assert got == text.strip() == "Pune"
