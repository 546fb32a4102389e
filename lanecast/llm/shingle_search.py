"""Containment search for short word passages in long documents, in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text; a shingle is ``SHINGLE`` words. A *target* (a benchmark
item, a licence text) is cut into pieces; a document is read in overlapping windows. Both have a one-permutation
MinHash sketch: shingle hashes fall into ``BINS`` bins and each bin keeps its smallest. A piece and a window collide
if a bin has the same smallest hash in both (bands of one row), so the collision probability is at least
``1 - (1 - J) ** b`` for the Jaccard similarity J and the b filled bins of the piece. Pieces of up to ``SHORT`` shingles
have windows of one shingle, so every document that holds a shingle of their sketch collides.

Retrieval reads the sketches alone. A window can only collide through a hash that is in some piece's sketch, so the
shingles of a document are joined with those entries and the window minimum is checked for the hits; this is the full
sketch join, from one scan of the texts, without writing window sketches out or shuffling texts. It gives pairs of a
document and a target. Only the retrieved documents are then read again, for all their shingles, and a pair is kept by
the exact containment of shingle texts in the whole document.

Both joins broadcast fixed-size rows in blocks of ``BLOCK_ENTRIES`` hashes, cut by hash: a target may lie in several
blocks, so neither many targets nor a very long one make a larger broadcast, only more passes. The keys of the
retrieved documents go to the planner's join by the size of their stored table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import stored
from lanecast.session import materialize

SHINGLE = 5
BINS = 64
CONTAINMENT = 0.8
#: Up to so many shingles, ``CONTAINMENT`` asks for all of them: every sketch entry is in a document that has the piece.
SHORT = 4
#: Hashes that are broadcast at a time (with their window lengths, a few dozens at most: under 50 MB).
BLOCK_ENTRIES = 250_000
#: Fixed: what counts as between words, in the lower-cased text.
BETWEEN = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _gram(words: Column, at: Column) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + j) for j in range(SHINGLE)])


def _hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(SHINGLE)])


def row_keys(text: Column, doc_id: Column) -> list[Column]:
    """Two hashes that stand for a row: rows of equal id and text have equal answers."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2")]


def _positions(df: DataFrame) -> DataFrame:
    """A row for each shingle position ``at`` of rows with ``words``."""
    return (df.where(F.size("words") >= SHINGLE)
            .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE))))


def target_shingles(targets: DataFrame, target_id: str, text: str = "text") -> DataFrame:
    """Distinct ``(target, first, gram, h)``: the shingles of every target and where each first occurs."""
    base = targets.select(F.col(target_id).alias("target"), words_of(F.col(text)).alias("words"))
    return (_positions(base.where("target IS NOT NULL")).select("target", "at", _gram(F.col("words"), F.col("at")).alias("gram"),
                                     _hash(F.col("words"), F.col("at")).alias("h"))
            .groupBy("target", "gram", "h").agg(F.min("at").alias("first")))


def sketches(shingles: DataFrame, growth: float) -> DataFrame:
    """``(target, piece, h, length, step)``: smallest hash per bin of each piece, and its size class's windows.

    ``shingles`` has ``target, piece, h``. Class c holds pieces of ``growth ** c <= q < growth ** (c + 1)`` shingles;
    its windows are ``hi + step`` shingles long, for hi the largest q of the class and a step of ``hi / 4``. Pieces of
    up to ``SHORT`` shingles have windows of one shingle.
    """
    size = shingles.groupBy("target", "piece").agg(F.count("*").alias("q"))
    top = F.ceil(F.pow(F.lit(growth), F.floor(F.log(F.col("q") + 0.0) / math.log(growth) + 1e-9) + 1)).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.col("hi") / 4)).cast("int")
    short = F.col("q") <= SHORT
    classes = size.select("target", "piece", "q", top.alias("hi")).select(
        "target", "piece", F.when(short, 1).otherwise(F.col("hi") + step).alias("length"),
        F.when(short, 1).otherwise(step).alias("step"))
    low = shingles.groupBy("target", "piece", F.pmod("h", F.lit(BINS)).alias("bin")).agg(F.min("h").alias("h"))
    return low.join(classes, ["target", "piece"]).select("target", "piece", "h", "length", "step")


def _blocks(hashes: DataFrame) -> list[DataFrame]:
    """``hashes``, one row for each ``h``, in parts of about ``BLOCK_ENTRIES`` rows."""
    n = max(1, math.ceil(hashes.count() / BLOCK_ENTRIES))
    return [hashes.where(F.pmod(F.xxhash64("h"), F.lit(n)) == i) for i in range(n)]


def _at_entries(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The shingle positions of ``rows`` whose hash is in ``hashes``, with its other columns."""
    return _positions(rows).withColumn("h", _hash(F.col("words"), F.col("at"))).join(F.broadcast(hashes), "h")


def _collisions(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, h, length)``: sketch entries that are the smallest of their bin in some window of a document,
    and the lengths of those windows. ``entries`` has ``h, windows``."""
    at, h = F.col("at"), F.col("h")

    def smaller(p):
        other = _hash(F.col("words"), p)
        return (F.pmod(other, F.lit(BINS)) == F.pmod(h, F.lit(BINS))) & (other < h)

    reach = F.array_max(F.col("windows.length"))
    last = F.size("words") - SHINGLE
    left = F.coalesce(F.array_max(F.filter(F.sequence(F.greatest(F.lit(0), at - reach), at), smaller)), F.lit(-1))
    right = F.coalesce(F.array_min(F.filter(F.sequence(at, F.least(last, at + reach)), smaller)), last + 1 + reach)

    def collides(w):  # a window [s * step, s * step + length) that holds ``at`` and no smaller hash of its bin
        low = F.greatest(F.floor((at - w.length) / w.step) + 1, F.floor(F.col("left") / w.step) + 1, F.lit(0))
        high = F.least(F.floor(at / w.step), F.floor((F.col("right") - w.length) / w.step))
        return low <= high

    return (_at_entries(rows, entries).withColumns({"left": left, "right": right})
            .select("doc_id", "k1", "k2", "h", F.explode(F.filter("windows", collides).getField("length")).alias("length")))


def retrieve(docs: DataFrame, pieces: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, k1, k2, target)``: documents and targets whose sketches collide, stored; ``pieces`` as in ``search``."""
    rows = docs.select("doc_id", *row_keys(F.col(text), F.col("doc_id")), words_of(F.col(text)).alias("words"))
    entries = materialize(pieces.groupBy("h").agg(F.collect_set(F.struct("length", "step")).alias("windows")))
    owners = pieces.select("target", "h", "length").distinct()
    pairs = [stored(_collisions(rows, block).distinct().join(owners, ["h", "length"])
                    .select("doc_id", "k1", "k2", "target").distinct()) for block in _blocks(entries)]
    return pairs[0] if len(pairs) == 1 else reduce(DataFrame.union, pairs).distinct()


def search(docs: DataFrame, shingles: DataFrame, pieces: DataFrame, text: str = "text",
           containment: float = CONTAINMENT) -> DataFrame:
    """Targets contained in documents: ``(doc_id, k1, k2, target, shingles, shared)``, one row per document and target.

    ``shingles(target, gram, h)`` comes from ``target_shingles`` and ``pieces`` from ``sketches``; both are stored.
    """
    pairs = retrieve(docs, pieces, text)
    found = stored(pairs.select("k1", "k2").distinct())
    own = shingles.join(pairs.select("target").distinct(), "target", "left_semi")
    wanted = materialize(own.select("h").distinct())
    k1, k2 = row_keys(F.col(text), F.col("doc_id"))
    rows = (docs.select(F.col(text).alias("text"), k1, k2).join(found, ["k1", "k2"], "left_semi")
            .select("k1", "k2", words_of(F.col("text")).alias("words")))
    hits = [stored(_at_entries(rows, block).select("k1", "k2", _gram(F.col("words"), F.col("at")).alias("gram")).distinct())
            for block in _blocks(wanted)]
    shared = (pairs.join(own.select("target", "gram"), "target")
              .join(reduce(DataFrame.union, hits), ["k1", "k2", "gram"], "left_semi")
              .groupBy("doc_id", "k1", "k2", "target").agg(F.count("*").alias("shared")))
    sizes = own.groupBy("target").agg(F.count("*").alias("shingles"))
    return (shared.join(sizes, "target").where(F.col("shared") >= F.lit(containment) * F.col("shingles"))
            .select("doc_id", "k1", "k2", "target", "shingles", "shared"))
