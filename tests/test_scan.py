import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lanecast.operators import scan as SC


def _hot_frame(spark, n=3000, seed=5):
    """One key holds over a third of the rows; NULL keys, NULL order values and ties included."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "HOT" if i % 3 == 0 else (None if i % 97 == 0 else f"K{rnd.randint(0, 40)}")
        t = None if i % 89 == 0 else rnd.randint(0, 500)
        rows.append((key, t, f"b{i:05d}", rnd.randint(0, 1)))
    return spark.createDataFrame(rows, "k string, t int, b string, f int")


ORDER = ["t", "b"]


def _sort():
    return [F.col(c).asc_nulls_last() for c in ORDER]


def _plain(df, keys=("k",)):
    w = Window.partitionBy(*keys).orderBy(*_sort())
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", (F.row_number().over(w) - 1).alias("_pos"), F.count("b").over(wp).alias("nb"),
                     F.coalesce(F.sum("f").over(wp), F.lit(0)).alias("sf"), F.lead(F.struct("t", "f")).over(w).alias("_next"))


COLS = ["b", "_pos", "nb", "sf", "_next"]
RUN = dict(counts={"nb": "b"}, sums={"sf": "f"}, leads=["t", "f"])


def test_chunked_scan_equals_plain_window(spark):
    df = _hot_frame(spark)
    want = sorted(_plain(df).select(*COLS).collect())
    for chunk in (3000, 1000, 430, 190):
        assert sorted(SC.chunked_scan(df, ["k"], ORDER, rows_per_chunk=chunk, **RUN).select(*COLS).collect()) == want, chunk


def test_chunks_follow_from_the_rows_alone(spark):
    """Bounds cut even chunks; a row's chunk is the same under any partitioning, and the rows are shuffled once."""
    df = spark.range(60_000).select(F.lit("HOT").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("int").alias("t"),
                                    F.col("id").cast("string").alias("b"), F.lit(1).alias("f"))
    at = F.struct(F.col("k"), F.col("t"))
    for chunks in (2, 3, 10, 37):
        bounds = SC._range_bounds(df, at, chunks, 60_000)
        of = lambda x: SC._with_chunk(x, at, bounds, chunks).select("b", "t", F.col("_chunk").alias("c"))
        one = of(df)
        assert one.exceptAll(of(df.repartition(13))).count() == 0
        sizes = {r.c: r["count"] for r in one.groupBy("c").count().collect()}
        assert sorted(sizes) == list(range(chunks)) and max(sizes.values()) < 2 * 60_000 / chunks
        spans = one.groupBy("c").agg(F.min("t"), F.max("t")).orderBy("c").collect()
        assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    out = SC.chunked_scan(df, ["k"], ORDER, rows_per_chunk=5000, sums={"sf": "f"})
    assert out.where("_pos <> sf").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("hot_rows", [10**6, 500, 20])
def test_ordered_scan_equals_plain_window_and_sort_rank(spark, hot_rows):
    df = _hot_frame(spark, 1200)
    out = SC.ordered_scan(df, ["k"], ORDER, global_position=True, hot_rows=hot_rows, rows_per_chunk=90, **RUN)
    assert sorted(out.select(*COLS).collect()) == sorted(_plain(df).select(*COLS).collect())
    rank = df.withColumn("r", F.row_number().over(Window.orderBy(F.col("k").asc_nulls_last(), *_sort())) - 1)
    assert dict(out.select("b", "_gpos").collect()) == dict(rank.select("b", "r").collect())
    assert out.columns == [*df.columns, "_pos", "nb", "sf", "_next", "_gpos"]


def test_null_keys_and_separators_are_keys_of_their_own(spark):
    rows = [(None, "a"), ("\U0010ffff", "a"), ("", "a"), ("x\x01y", "z"), ("x", "y\x01z"), ("x", None), (None, None)]
    df = spark.createDataFrame([(a, b, i % 2, f"b{i}", 1) for i, (a, b) in enumerate(rows * 2)],
                               "k string, k2 string, t int, b string, f int")
    got = SC.ordered_scan(df, ["k", "k2"], ORDER, hot_rows=1, rows_per_chunk=3, **RUN)
    assert sorted(got.select(*COLS).collect()) == sorted(_plain(df, ("k", "k2")).select(*COLS).collect())


@pytest.mark.parametrize("small", [True, False])
def test_exact_quantiles_match_numpy_linear(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(SC, "SMALL_DISTINCT", 0)
    rnd = np.random.default_rng(1)
    vals = np.concatenate([rnd.normal(size=700), rnd.integers(0, 20, size=300).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double")
    qs = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.8, 0.9, 1.0]
    got = SC.exact_quantiles(df, "v", qs)
    want = np.quantile(vals, qs, method="linear")
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert SC.exact_quantiles(df, "v", [0.5]) == [None]


@pytest.mark.parametrize("band_rows", [1, 40, 10**9])
def test_quantiles_by_narrowing_match_numpy(spark, band_rows):
    """Many rounds of narrowing, ties, constants, heavy ends, NaN, NULL, infinities, one value and no value."""
    rng = random.Random(3)
    n = 3000
    nan = float("nan")
    cols = {"u": [rng.random() for _ in range(n)], "ties": [float(rng.randrange(4)) for _ in range(n)],
            "same": [7.5] * n, "heavy": [0.0] * (n - 3) + [1.0, 2.0, 1e9], "exp": [rng.expovariate(1) ** 5 for _ in range(n)],
            "gaps": [None if i % 3 == 0 else nan if i % 3 == 1 else float(i) for i in range(n)],
            "inf": [float("inf") if i % 50 == 0 else -float(i) for i in range(n)], "one": [3.0] + [None] * (n - 1), "none": [None] * n}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    qs = [0.0, 0.001, 0.25, 0.5, 0.8, 0.9, 0.9999, 1.0]
    got = SC.exact_quantiles_multi(df, {c: qs for c in cols}, band_rows=band_rows)
    for c, vals in cols.items():
        vals = [v for v in vals if v is not None and v == v]
        assert got["_counts"][c] == len(vals)
        if not vals:
            assert got[c] == [None] * len(qs)
        elif c == "inf":          # numpy interpolates infinities to NaN: compare away from them
            assert got[c][2:6] == pytest.approx(list(np.quantile(vals, qs[2:6])))
        else:
            assert got[c] == pytest.approx(list(np.quantile(vals, qs)), rel=1e-12)


def test_narrowing_orders_small_bands_only(spark, monkeypatch):
    """Of 200,000 values, no more than the bands' rows are counted one by one."""
    seen = []
    narrowed = SC._narrowed
    monkeypatch.setattr(SC, "_narrowed", lambda *a: seen.append(narrowed(*a)) or seen[-1])
    df = spark.range(200_000).select(F.rand(4).alias("x"))
    got = SC.exact_quantiles_multi(df, {"x": [0.2, 0.8]}, band_rows=1000)
    assert len(seen) <= 2 and all(b.n <= 1000 for b in seen[-1])
    assert got["x"] == pytest.approx(list(df.agg(F.percentile("x", [0.2, 0.8])).first()[0]), rel=1e-12)


def test_a_chunk_is_found_by_binary_search(spark):
    """Each bound count up to 70, NULL and tied values: the chunk is the number of bounds reached; none is filtered."""
    df = spark.createDataFrame([(None if i % 11 == 0 else i // 3, f"b{i:03d}") for i in range(400)], "t int, b string")
    at = F.struct(F.col("t").isNull().alias("n"), F.col("t").alias("v"), F.col("b").alias("w"))
    for chunks in (2, 3, 4, 5, 8, 9, 33, 70):
        bounds = SC._range_bounds(df, at, chunks, 400)
        cuts = sorted((b.n, b.v or 0, b.w) for b in bounds.first()["bounds"])
        got = SC._with_chunk(df, at, bounds, chunks)
        for r in got.collect():
            assert r["_chunk"] == sum(c <= (r.t is None, r.t or 0, r.b) for c in cuts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "_at" not in got.columns and "_bounds" not in got.columns


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_counts_may_come_from_other_stored_rows(spark, hot_rows):
    """A scan over the result of another scan: the keys are counted in the stored rows, whether or not one is hot."""
    df = _hot_frame(spark, 1200)
    first = SC.ordered_scan(df, ["f"], ["t", "b"], sums={"flags": "f"}).withColumnRenamed("_pos", "at")
    out = SC.ordered_scan(first, ["k"], ORDER, global_position=True, hot_rows=hot_rows, rows_per_chunk=90, counted=df, **RUN)
    assert sorted(out.select(*COLS).collect()) == sorted(_plain(df).select(*COLS).collect())
    assert out.where("at IS NULL OR _gpos IS NULL").isEmpty()


@pytest.mark.parametrize("rows_per_chunk", [None, 400, 90, 7])
def test_scans_over_ranges_equal_plain_windows(spark, rows_per_chunk):
    """Two scans of one dealing: keys that lie in any range, then those that lead the order, with NULLs and a hot key."""
    df = _hot_frame(spark, 1200).withColumn("lane", F.when(F.crc32("b") % 7 > 0, F.crc32("b") % 7))
    order = ["k", *ORDER]
    rows, ranges = SC.range_rows(df, order, df.columns, rows_per_chunk=rows_per_chunk)
    lane = SC.ordered_scan(rows, ["lane"], order, counts={"lb": "b", "lt": "t"}, sums={"lf": "f"}, ranges=ranges)
    lane = lane.withColumnRenamed("_pos", "at")
    out = SC.ordered_scan(lane, ["k"], ORDER, global_position=True, ranges=ranges, **RUN)
    assert sorted(out.select(*COLS).collect()) == sorted(_plain(df).select(*COLS).collect())
    by_order = [F.col(c).asc_nulls_last() for c in order]
    w = Window.partitionBy("lane").orderBy(*by_order)
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("b", F.row_number().over(w) - 1, F.count("b").over(wp), F.count("t").over(wp),
                      F.coalesce(F.sum("f").over(wp), F.lit(0)), F.row_number().over(Window.orderBy(*by_order)) - 1)
    assert sorted(out.select("b", "at", "lb", "lt", "lf", "_gpos").collect()) == sorted(plain.collect())


def test_the_next_row_needs_keys_that_lead_the_ranges(spark):
    df = _hot_frame(spark, 50)
    rows, ranges = SC.range_rows(df, ["k", *ORDER], df.columns)
    with pytest.raises(ValueError, match="lead the order"):
        SC.ordered_scan(rows, ["f"], ["k", *ORDER], leads=["b"], ranges=ranges)
