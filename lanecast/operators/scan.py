"""Ordered running scans that stay parallel when one key holds a large share of the rows.

``ordered_scan`` is the entry point: keys of up to ``HOT_ROWS`` rows run as one ordinary window
after one hash exchange; only keys beyond that (found by one count per key) go through
``chunked_scan``.

``chunked_scan`` computes, for every row, aggregates over the *earlier* rows of its key
(``ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING``), its 0-based position and the
next row's values (``lead``).  A plain ``Window.partitionBy(key)`` sends a hot key to a
single task; here a stored table of range bounds over (key, order), drawn from a sample, cuts the
rows into contiguous chunks, and a row's chunk id follows from comparing it with the bounds.  Any
pass, and any recomputation after a loss, therefore gives a row the same chunk, so the rows are
shuffled once, into the windows of their chunks, and need not be stored.  The carry-in of a chunk
(totals of the earlier chunks of the same key, first row of the next chunk) comes from a
map-side combined table with one row per (key, chunk) for keys that span several chunks.  Range
chunks are contiguous, so at most one key crosses each bound and that table never exceeds
2 x chunks rows (``MAX_CHUNKS`` chunks at most): it is broadcast on that bound.

``range_rows`` serves several scans whose orders agree with one order of all rows: the first one shuffles the rows to
contiguous ranges of that order, and each scan given these ``Ranges`` runs in the windows of (range, key).  What a key
brings into a range comes from a map-side combined table with one row per (range, key), read from the stored rows.

``exact_quantiles_multi`` narrows each quantile down to a small band of values by counting around
approximate pivots, and orders only the values of that band, so no value outside it is shuffled and
no task or driver ever holds all values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanecast.session import materialize, shuffle_partitions, stage_table

SMALL_DISTINCT = 1_000_000   # distinct values one task may order (a few MB)
BAND_ROWS = 250_000          # rows of a band of values that are counted one by one
PIVOT_ACCURACY = 10_000      # of the approximate percentiles that narrow a band
HOT_ROWS = 250_000           # rows of one key that one task may order
ROWS_PER_CHUNK = 250_000     # rows of a range chunk in the scan of the keys beyond that
MAX_CHUNKS = 4_096           # beyond that many chunks they get longer, and a task's sort spills
SAMPLE_PER_CHUNK = 100       # rows drawn per chunk for the range bounds
RANGE_ROWS = 20_000          # rows of a range at least, where ranges are cut finer to keep all tasks busy
RANGE = "_range"             # column with the range of a dealt row


def _key_column(keys: list[str]) -> Column:
    """One key whose order is the tuple order of ``keys`` as text (NULLs last); NULL is a key of its own."""
    if not keys:
        return F.lit("")
    return F.struct(*[x for k in keys for x in (F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit("")))])


def _ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _place(order: list[str]) -> list[Column]:
    """Fields ``n0, v0, n1, v1, ...`` whose struct order is that of ``_ascending``."""
    return [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))]


def _running(df: DataFrame, keys: list, order: list[str], counts: dict, sums: dict, leads: list,
             prefix: str = "") -> DataFrame:
    """``df`` with position, running counts and sums and the next row in the windows of ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*_ascending(order))
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    sel = [F.col("*"), (F.row_number().over(w) - 1).alias(f"{prefix or '_'}pos")]
    sel += [F.count(c).over(wp).alias(f"{prefix}{name}") for name, c in counts.items()]
    sel += [F.coalesce(F.sum(c).over(wp), F.lit(0)).alias(f"{prefix}{name}") for name, c in sums.items()]
    if leads:
        sel.append(F.lead(F.struct(*leads)).over(w).alias(f"{prefix or '_'}next"))
    return df.select(*sel)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], *, counts: dict[str, str] | None = None,
                 sums: dict[str, str] | None = None, leads: list[str] | None = None, global_position: bool = False,
                 hot_rows: int = HOT_ROWS, rows_per_chunk: int = ROWS_PER_CHUNK,
                 counted: DataFrame | None = None, ranges: Ranges | None = None) -> DataFrame:
    """The columns of ``chunked_scan`` (which see), splitting only keys of more than ``hot_rows`` rows.

    ``df`` is read several times, so it should be stored: to count the rows per key, to draw the bounds and for the scan.
    ``counted`` names stored rows with the same keys: the counts come from them, so ``df`` is read once and need not be
    stored; where a key is hot, it is stored here.
    ``ranges`` are those of ``df`` (see ``range_rows``): every key is split by range, and no option matters.
    """
    counts, sums, leads = counts or {}, sums or {}, leads or []
    if ranges is not None:
        return _range_scan(df, keys, order, ranges, counts, sums, leads, global_position)
    sizes = materialize((df if counted is None else counted).groupBy(_key_column(keys).alias("_key"))
                        .agg(F.count(F.lit(1)).alias("_n")))
    hot = sizes.where(F.col("_n") > hot_rows)
    n_hot = hot.agg(F.sum("_n")).first()[0] or 0
    if n_hot and counted is not None:
        df = stage_table(df, "scan-input")
    base = df.withColumn("_key", _key_column(keys))
    cold = base.join(hot.select("_key"), "_key", "left_anti") if n_hot else base
    names = [*df.columns, "_key", "_pos", *counts, *sums, *(["_next"] if leads else [])]
    if not n_hot and not global_position:          # the key need not travel beside its columns
        return _running(df, [F.col(k).cast("string") for k in keys], order, counts, sums, leads).select(
            *[n for n in names if n != "_key"])
    out = _running(cold, ["_key"], order, counts, sums, leads).select(*names)
    if n_hot:
        rows = base.join(hot.select("_key"), "_key", "left_semi")
        split = chunked_scan(rows, keys, order, counts=counts, sums=sums, leads=leads, rows=n_hot,
                             rows_per_chunk=rows_per_chunk, key="_key")
        out = out.unionByName(split.select(*names))
    if not global_position:
        return out.drop("_key")
    # rows of all earlier keys: one prefix sum over the table of keys
    before = chunked_scan(sizes, [], ["_key"], sums={"_before": "_n"}).select("_key", "_before")
    return (out.join(before, "_key").withColumn("_gpos", F.col("_before") + F.col("_pos")).drop("_key", "_before"))


def _range_bounds(df: DataFrame, at: Column, chunks: int, rows: int) -> DataFrame:
    """One stored row with ``bounds``: ``chunks - 1`` ascending values of ``at``.

    The values are those at even ranks of a sample of ``SAMPLE_PER_CHUNK`` rows a chunk, so the row is bounded by
    ``MAX_CHUNKS``.
    """
    share = min(1.0, SAMPLE_PER_CHUNK * chunks / max(rows, 1))
    drawn = df.select(at.alias("at"))
    drawn = (drawn.sample(share, seed=17) if share < 1 else drawn).agg(F.sort_array(F.collect_list("at")).alias("s"))
    place = lambda i: F.get("s", F.floor(i * F.size("s") / chunks).cast("int"))
    return materialize(drawn.select(F.transform(F.sequence(F.lit(1), F.lit(chunks - 1)), place).alias("bounds")))


def _with_chunk(df: DataFrame, at: Column, bounds: DataFrame, chunks: int) -> DataFrame:
    """``df`` with ``_chunk``, the number of bounds that ``at`` has reached, by a binary search.

    Each halving is a projection of its own, so at most 12 bounds are compared with a row, all in compiled code (a filter
    over the array compares them one by one in interpreted code).  The bounds are a scalar subquery of the stored row and
    are not copied into rows.  Past the last bound ``get`` gives NULL, which counts as not reached.
    """
    out = df.withColumns({"_bounds": bounds.select("bounds").scalar(), "_at": at, "_chunk": F.lit(0)})
    step = 1 << max(chunks - 1, 1).bit_length() - 1
    while step:
        reached = F.get("_bounds", F.col("_chunk") + F.lit(step - 1)) <= F.col("_at")
        out = out.withColumn("_chunk", F.col("_chunk") + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return out.drop("_bounds", "_at")


def chunked_scan(df: DataFrame, keys: list[str], order: list[str], *,
                 counts: dict[str, str] | None = None, sums: dict[str, str] | None = None,
                 leads: list[str] | None = None, rows: int | None = None, rows_per_chunk: int = ROWS_PER_CHUNK,
                 key: str | None = None) -> DataFrame:
    """Add running 'earlier rows' aggregates per key.

    Output columns: ``_pos`` (0-based position within key), one column per entry of
    ``counts`` (non-NULL count over earlier rows) and ``sums`` (sum over earlier rows,
    0 when there are none) and ``_next`` (struct of ``leads`` from the next row of the key,
    NULL for the last row).  ``order`` names columns, ascending with NULLs last, that must be a total order
    within the key.  ``rows`` is the number of rows, counted where it is not given.  ``key`` names a
    column that holds the key already; it is kept.

    ``df`` is read once for the bounds, once for the chunk summary and once for the windows, so it should be stored.
    """
    counts, sums, leads = counts or {}, sums or {}, leads or []
    own = F.col(key) if key else _key_column(keys)
    base = df.withColumn("_k", own)
    rows = df.count() if rows is None else rows
    chunks = min(max(1, -(-rows // rows_per_chunk)), MAX_CHUNKS)
    names = [F.col(f"`{c}`") for c in df.columns]
    if chunks == 1:
        found = _running(base, ["_k"], order, counts, sums, leads)
        return found.select(*names, "_pos", *counts, *sums, *(["_next"] if leads else []))
    at = F.struct(own.alias("k"), *_place(order))
    base = _with_chunk(base, at, _range_bounds(base, at, chunks, rows), chunks)
    local = _running(base, ["_k", "_chunk"], order, counts, sums, leads, "_l_")

    # one row per (key, chunk): sizes, totals and the first row of the chunk
    aggs = [F.count(F.lit(1)).alias("_cn")]
    aggs += [F.count(c).alias(f"_ct_{name}") for name, c in counts.items()]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(f"_ct_{name}") for name, c in sums.items()]
    if leads:
        aggs.append(F.min_by(F.struct(*leads), at).alias("_cfirst"))
    summ = base.groupBy("_k", "_chunk").agg(*aggs)

    wk = Window.partitionBy("_k").orderBy("_chunk")
    wkp = wk.rowsBetween(Window.unboundedPreceding, -1)
    spanning = (summ.withColumn("_nch", F.count(F.lit(1)).over(Window.partitionBy("_k")))
                .where(F.col("_nch") > 1))
    osel = [F.col("_k"), F.col("_chunk"), F.coalesce(F.sum("_cn").over(wkp), F.lit(0)).alias("_o_pos")]
    osel += [F.coalesce(F.sum(f"_ct_{name}").over(wkp), F.lit(0)).alias(f"_o_{name}")
             for name in list(counts) + list(sums)]
    if leads:
        osel.append(F.lead("_cfirst").over(wk).alias("_o_next"))
    # bounded by 2 x chunks rows (see module docstring)
    offsets = F.broadcast(materialize(spanning.select(*osel)))

    out = local.join(offsets, ["_k", "_chunk"], "left")
    fin = names
    fin.append((F.col("_l_pos") + F.coalesce(F.col("_o_pos"), F.lit(0))).alias("_pos"))
    for name in list(counts) + list(sums):
        fin.append((F.col(f"_l_{name}") + F.coalesce(F.col(f"_o_{name}"), F.lit(0))).alias(name))
    if leads:
        fin.append(F.coalesce("_l_next", "_o_next").alias("_next"))
    return out.select(*fin)


@dataclass(frozen=True)
class Ranges:
    """``n`` contiguous ranges of ``order`` over the rows of ``stored``; the ``bounds`` between them are one stored row."""

    order: list[str]
    stored: DataFrame
    bounds: DataFrame
    n: int

    def of(self, df: DataFrame) -> DataFrame:
        """``df`` with the range of each row."""
        at = F.struct(*_place(self.order))
        return _with_chunk(df, at, self.bounds, self.n).withColumnRenamed("_chunk", RANGE)


def range_rows(df: DataFrame, order: list[str], columns: list[str], *, rows_per_chunk: int | None = None,
               ) -> tuple[DataFrame, Ranges]:
    """``columns`` of the stored ``df`` with the contiguous range of ``order`` (ascending, NULLs last) of each row.

    For ``ordered_scan``, whose first scan shuffles the rows by range; the next ones leave them there.  A scan fits the
    ranges where the rows of its key come in the order of the ranges, as they do if its order is ``order`` or if its keys
    and its order together are.  Rows with equal ``order`` columns share a range.  A range has about ``rows_per_chunk``
    rows; by default ``ROWS_PER_CHUNK``, or fewer where that leaves tasks idle.
    """
    rows = df.count()
    chunks = -(-rows // (rows_per_chunk or ROWS_PER_CHUNK))
    if rows_per_chunk is None:
        chunks = max(chunks, min(4 * shuffle_partitions(df.sparkSession), rows // RANGE_ROWS))
    chunks = min(max(1, chunks), MAX_CHUNKS)
    at = F.struct(*_place(order))
    ranges = Ranges(order, df, _range_bounds(df, at, chunks, rows), chunks)
    return ranges.of(df).select(*[F.col(f"`{c}`") for c in columns], RANGE), ranges


def _range_scan(df: DataFrame, keys: list[str], order: list[str], ranges: Ranges, counts: dict, sums: dict, leads: list,
                global_position: bool) -> DataFrame:
    """``ordered_scan`` over rows with a range: windows of (range, key), and what the key brings along from other ranges."""
    if ranges.order == [*keys, *order]:
        return _leading_scan(df, keys, order, ranges, counts, sums, leads, global_position)
    if leads or global_position:
        raise ValueError("the next row and the global position need keys that lead the order of the ranges")
    return _crossing_scan(df, keys, order, ranges, counts, sums)


def _crossing_scan(df: DataFrame, keys: list[str], order: list[str], ranges: Ranges, counts: dict, sums: dict) -> DataFrame:
    """A scan of keys that lie in any number of ranges: the totals of a key's earlier ranges are rows of their own.

    They are shuffled with the rows and come first in the window of their (range, key), so no join moves the rows again.
    """
    n = {"_pos": F.lit(1).cast("long"), **{name: F.col(c).isNotNull().cast("long") for name, c in counts.items()},
         **{name: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for name, c in sums.items()}}
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.of(ranges.stored).groupBy(RANGE, *keys).agg(*[F.sum(x).alias(name) for name, x in n.items()])
    carry = (totals.select(RANGE, *keys, F.struct(*[F.sum(name).over(earlier).alias(name) for name in n]).alias("_carry"))
             .where(F.col("_carry._pos").isNotNull()))
    kinds = ", ".join(f"{name}: bigint" for name in n)
    rows = (df.withColumn("_carry", F.lit(None).cast(f"struct<{kinds}>"))
            .unionByName(carry, allowMissingColumns=True).repartition(RANGE))
    w = Window.partitionBy(RANGE, *keys).orderBy(F.col("_carry").isNull(), *_ascending(order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.select(*[F.col(f"`{c}`") for c in df.columns], "_carry", *[
        F.coalesce(F.sum(F.coalesce(F.col(f"_carry.{name}"), x)).over(before), F.lit(0)).alias(name) for name, x in n.items()])
    return scanned.where(F.col("_carry").isNull()).drop("_carry")


def _leading_scan(df: DataFrame, keys: list[str], order: list[str], ranges: Ranges, counts: dict, sums: dict, leads: list,
                  global_position: bool) -> DataFrame:
    """A scan of keys that lead the order of the ranges: only a key with a bound among its rows lies in several.

    Those are two ranges a bound at most, so the table of their totals and first rows is broadcast on that bound.
    """
    same = lambda left, right: [left[k].eqNullSafe(right[k]) for k in keys]
    cut = ranges.bounds.select(F.explode("bounds").alias("b"))
    cut = cut.select(*[F.col(f"b.v{i}").alias(k) for i, k in enumerate(keys)]).distinct()
    aggs = [F.count(F.lit(1)).alias("_c__pos")]
    aggs += [F.count(c).alias(f"_c_{name}") for name, c in counts.items()]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(f"_c_{name}") for name, c in sums.items()]
    if leads:
        aggs.append(F.min_by(F.struct(*leads), F.struct(*_place(ranges.order))).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(RANGE)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_c_{name}").over(earlier).alias(f"_o_{name}") for name in ("_pos", *counts, *sums)]
    if leads:
        carried.append(F.lead("_first").over(w).alias("_o__next"))
    split = ranges.stored.join(F.broadcast(cut), same(ranges.stored, cut), "left_semi")
    carry = F.broadcast(stage_table(ranges.of(split).groupBy(RANGE, *keys).agg(*aggs).select(RANGE, *keys, *carried), "carry"))

    # a NULL key is a key of its own; its flag goes before it, so that one sort serves the place in the range, too
    flags = [f"_n{i}" for i in range(len(keys))]
    flagged = [x for pair in zip(flags, keys) for x in pair]
    base = df.withColumns({f: F.col(k).isNull() for f, k in zip(flags, keys)})
    # the widest window first: the rows lie by range for the others, too
    place = Window.partitionBy(RANGE).orderBy(*flagged, *_ascending(order))
    base = base.withColumn("_place", F.row_number().over(place) - 1)
    local = _running(base, [RANGE, *flagged], order, counts, sums, leads, "_l_")
    met = local[RANGE] == carry[RANGE]
    for c in same(local, carry):
        met = met & c
    out = local.join(carry, met, "left").drop(carry[RANGE], *[carry[k] for k in keys])
    fin = [F.col(f"`{c}`") for c in df.columns]
    fin += [(F.col(held) + F.coalesce(F.col(f"_o_{name}"), F.lit(0))).alias(name)
            for name, held in {"_pos": "_l_pos", **{x: f"_l_{x}" for x in (*counts, *sums)}}.items()]
    if leads:
        fin.append(F.coalesce("_l_next", "_o__next").alias("_next"))
    if not global_position:
        return out.select(*fin)
    sizes = ranges.of(ranges.stored).groupBy(RANGE).agg(F.count(F.lit(1)).alias("_cn"))         # one row a range
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage_table(sizes.select(RANGE, F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_start")), "starts")
    fin.append((F.col("_start") + F.col("_place")).alias("_gpos"))
    return out.join(F.broadcast(starts), RANGE).select(*fin)


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Linear-interpolated quantiles of the non-NULL values of one column (see ``exact_quantiles_multi``)."""
    return exact_quantiles_multi(df, {column: qs})[column]


@dataclass(frozen=True)
class _Band:
    """The values of a column from ``low`` to ``high`` that hold a pair of ranks: ``below`` lie under, ``n`` within."""

    column: str
    h: float                # (n - 1) q: between the two ranks
    low: float
    high: float
    below: int
    n: int

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.h), math.ceil(self.h)

    def holds(self, v: Column) -> Column:
        return (v >= F.lit(self.low)) & (v <= F.lit(self.high))


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles ``c0``, ``c1``, ...; NaN becomes NULL."""
    values = [F.col(c).cast("double") for c in columns]
    return df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(values)])


def _narrowed(values: DataFrame, at: dict[str, str], bands: list[_Band], most: int) -> list[_Band]:
    """Each band of more than ``most`` rows cut to the part between two pivots that holds its ranks.

    Two aggregations over the columns, without a shuffle of values: the pivots are approximate percentiles just below
    and above the ranks; then the rows under and between them are counted, so the ranks' place stays exact.
    """
    wide = [b for b in bands if b.n > most and b.low < b.high]
    slack = 2.0 / PIVOT_ACCURACY
    ask = []
    for b in wide:
        v = F.col(at[b.column])
        lo, hi = ((r - b.below) / max(b.n - 1, 1) for r in b.ranks)
        ask.append(F.percentile_approx(F.when(b.holds(v), v), [max(0.0, lo - slack), min(1.0, hi + slack)], PIVOT_ACCURACY))
    pivots = values.agg(*[x.alias(f"p{i}") for i, x in enumerate(ask)]).first()
    count = []
    for b, (p, q) in zip(wide, pivots):
        v = F.col(at[b.column])
        count += [F.count_if((v >= F.lit(b.low)) & (v < F.lit(p))), F.count_if((v >= F.lit(p)) & (v <= F.lit(q)))]
    counted = values.agg(*[x.alias(f"n{i}") for i, x in enumerate(count)]).first()
    cut = {}
    for i, (b, (p, q)) in enumerate(zip(wide, pivots)):
        under, within = counted[2 * i:2 * i + 2]
        first, last = b.ranks
        if b.below + under <= first and last < b.below + under + within and within < b.n:
            cut[id(b)] = replace(b, low=p, high=q, below=b.below + under, n=within)
    return [cut.get(id(b), b) for b in bands]


def exact_quantiles_multi(df: DataFrame, spec: dict[str, list[float]], *, band_rows: int = BAND_ROWS
                          ) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles (the 'linear' rule) of several columns by range narrowing.

    value(q) = v[i] + (v[j] - v[i]) * (h - i) with h = (n - 1) q, i = floor(h), j = ceil(h),
    over the non-NULL, non-NaN values of each column.  Each quantile starts with the band of all values of its column.
    Bands above ``band_rows`` rows are narrowed (see ``_narrowed``), each time to about 4 / ``PIVOT_ACCURACY`` of their
    rows, until they are small or their ends are equal.  Only the values of the last bands are counted one by one:
    (band, value, count), then an ordered prefix count, in one window or, where ties keep a band wide, in the chunked
    scan.  Only the values around each requested rank reach the driver.
    The result also holds ``"_counts"``: the number of non-NULL values per column.
    """
    cols = list(spec)
    at = {c: f"c{i}" for i, c in enumerate(cols)}
    values = _numbers(df, cols)
    stats = values.agg(*[x for c in at.values() for x in (F.count(c), F.min(c), F.max(c))]).first()
    totals = {c: stats[3 * i:3 * i + 3] for i, c in enumerate(cols)}
    bands = [_Band(c, (totals[c][0] - 1) * q, totals[c][1], totals[c][2], 0, totals[c][0])
             for c in cols if totals[c][0] for q in dict.fromkeys(spec[c])]
    while True:
        before, bands = bands, bands if all(b.n <= band_rows or b.low == b.high for b in bands) else \
            _narrowed(values, at, bands, band_rows)
        if bands == before:
            break
    found: dict[tuple[str, float], dict[int, float]] = {}
    open_bands = []
    for b in bands:
        if b.low == b.high:
            found[b.column, b.h] = dict.fromkeys(b.ranks, b.low)
        else:
            open_bands.append(b)
    if open_bands:
        held = F.array(*[F.when(b.holds(F.col(at[b.column])), F.struct(F.lit(i).alias("i"), F.col(at[b.column]).alias("v")))
                         for i, b in enumerate(open_bands)])
        counts = (values.select(F.explode(F.array_compact(held)).alias("x")).select("x.i", "x.v")
                  .groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")))
        if max(b.n for b in open_bands) <= max(band_rows, SMALL_DISTINCT):
            # bounded per band: one ordered window per band
            w = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
            scanned = counts.withColumn("under", F.coalesce(F.sum("c").over(w), F.lit(0)))
        else:
            scanned = chunked_scan(stage_table(counts, "counts"), ["i"], ["v"], sums={"under": "c"})
        wanted = F.create_map(*[x for i, b in enumerate(open_bands)
                                for x in (F.lit(i), F.array(*[F.lit(r - b.below) for r in sorted(set(b.ranks))]))])
        hits = scanned.where(F.exists(wanted[F.col("i")], lambda r: (r >= F.col("under")) & (r < F.col("under") + F.col("c"))))
        for r in hits.select("i", "v", "under", "c").collect():
            b = open_bands[r["i"]]
            for rank in b.ranks:
                if r["under"] <= rank - b.below < r["under"] + r["c"]:
                    found.setdefault((b.column, b.h), {})[rank] = r["v"]
    out: dict = {"_counts": {c: totals[c][0] for c in cols}}
    for c in cols:
        out[c] = []
        for q in spec[c]:
            if not totals[c][0]:
                out[c].append(None)
                continue
            h = (totals[c][0] - 1) * q
            lo, hi = (found[c, h][r] for r in (math.floor(h), math.ceil(h)))
            out[c].append(lo if math.floor(h) == math.ceil(h) else lo + (hi - lo) * (h - math.floor(h)))
    return out
