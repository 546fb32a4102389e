"""SimHash near-duplicates: byte-position inverted index with count filtering, then star links and components.

Fingerprints of 64 bits have 8 positional bytes. Two that differ in at most d = 2 bits differ in at most 2 bytes, so
they share at least 6 positional bytes: the guaranteed minimum. Lists of one (position, byte) hold 1/256 of all rows,
so joining through them would be quadratic. The minimum allows longer entries: of the four byte-position pairs
(0-1, 2-3, 4-5, 6-7) at least two are equal, so an entry is the four bytes of two such pairs (six entries a
fingerprint). Pairs that meet in an entry tally their equal positional bytes; those below the minimum go, the rest
are verified by their differing bits.

An entry with more than ``ENTRY_PAIRS_MAX`` fingerprints is split by two more byte positions: two of its fingerprints
that link share two at least of the four positions outside it, so they meet in an entry of six equal bytes, which is the
guaranteed minimum itself. What is still above the limit then holds fingerprints that differ in two bytes only; it is
linked exactly in linear work: each fingerprint names itself and its neighbours at one bit within those two bytes; those
that name the same value are at most two bits apart, and a star over them (17 at most) links them all. ``entry_rows``
counts what goes each way.

Defined results: a null or blank text has fingerprint 0 and links like any other; equal fingerprints are linked;
repeated rows and repeated ids give one row each; a null id stays null and never becomes a component id unless the
whole component has none; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import ASCII_LOWER, free_name, map_rows, stored, word_pieces
from lanecast.llm.components import connected_components
from lanecast.session import materialize

BITS = 64
SEED = 42
#: Largest distance of a link, and the positional bytes that such a pair shares at least.
MAX_BITS = 2
LEAST_BYTES = 8 - MAX_BITS
#: Fingerprints in one index entry up to which pairs are tallied; larger entries are split, see above.
ENTRY_PAIRS_MAX = 64


def simhash64(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included; no word gives 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    tally = np.zeros(8 * 256, np.int64)
    total, tail = 0, []
    base = (np.arange(8, dtype=np.int64) * 256)[None, :]
    for words in word_pieces(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER)):
        words = tail + words
        tail = words[-(shingle - 1):] if shingle > 1 else []
        if len(words) < shingle:
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(words) - shingle + 1)
        tally += np.bincount((h.view(np.uint8).reshape(-1, 8) + base).ravel(), minlength=8 * 256)
        total += len(h)
    if not total:
        return xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    over = (tally.reshape(8, 256) @ bits) * 2 > total
    return int(np.packbits(over.ravel(), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``) and ``fp``, the fingerprint as a signed long."""
    keep = ["doc_id"] if keep is None else keep
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(df.select(F.col(text).alias("_text"), *keep),
                    lambda t, *k: (*k, _signed(simhash64(t, shingle))), f"{kinds}, fp bigint")


def _pair_masks() -> list[int]:
    """For each entry: the bits of its two byte-position pairs."""
    return [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a, b in combinations(range(4), 2)]


def _split_masks(mask: int) -> list[int]:
    """For each split of an entry: its bits and those of two more byte positions."""
    rest = [p for p in range(8) if not mask >> 8 * p & 1]
    return [mask | (0xFF << 8 * a) | (0xFF << 8 * b) for a, b in combinations(rest, 2)]


def _entries(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """``k, j, b, fp``: the entries of each ``(k, fp)``, one for each of ``masks[k]``, that hold other fingerprints too."""
    at = F.array(*[F.array(*[F.lit(_signed(m)) for m in of_k]) for of_k in masks])
    all_of = rows.select("k", "fp", F.posexplode(F.element_at(at, F.col("k") + 1)).alias("j", "m")).select(
        "k", "j", F.col("fp").bitwiseAND(F.col("m")).alias("b"), "fp")
    sizes = materialize(all_of.groupBy("k", "j", "b").agg(F.count("*").alias("n")).where("n > 1"))
    return all_of.join(sizes, ["k", "j", "b"])


def _tallied(entries: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Links ``(u, v)`` among the fingerprints of each entry: shared bytes tallied, then bits verified."""
    x, y = (entries.select("k", "j", "b", F.col("fp").alias(c)) for c in "uv")
    diff = F.col("u").bitwiseXOR(F.col("v"))
    tally = sum((diff.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0).cast("int") for p in range(8))
    at = F.array(*[F.array(*[F.lit(_signed(m)) for m in of_k]) for of_k in masks])
    # each pair in the first of the entries that it shares
    first = F.array_position(F.transform(F.element_at(at, F.col("k") + 1), lambda m: diff.bitwiseAND(m) == 0), True) - 1
    return (x.join(y, ["k", "j", "b"]).where("u < v").where(F.col("j") == first)
            .where(tally >= LEAST_BYTES).where(F.bit_count(diff) <= MAX_BITS).select("u", "v"))


def _index(fps: DataFrame) -> tuple[DataFrame, list[list[int]], DataFrame, list[list[int]]]:
    """The entries of four bytes with their masks, and of those above the limit the entries of six bytes with theirs."""
    masks = _pair_masks()
    entries = _entries(fps.select(F.lit(0).alias("k"), "fp"), [masks])
    splits = [_split_masks(m) for m in masks]
    hot = entries.where(F.col("n") > ENTRY_PAIRS_MAX).select(F.col("j").alias("k"), "fp")
    return entries, [masks], _entries(hot, splits), splits


def links(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` values -> links ``(u, v)`` that join the same fingerprints as all pairs up to two bits do."""
    entries, masks, split, splits = _index(fps)
    pairs = (_tallied(entries.where(F.col("n") <= ENTRY_PAIRS_MAX), masks)
             .union(_tallied(split.where(F.col("n") <= ENTRY_PAIRS_MAX), splits)))
    flips = F.array(*[F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1])
                                for m in of_k]) for of_k in splits])
    own = F.element_at(F.element_at(flips, F.col("k") + 1), F.col("j") + 1)
    named = (split.where(F.col("n") > ENTRY_PAIRS_MAX).select("k", "j", "fp", F.explode(own).alias("flip"))
             .select("k", "j", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name")))
    # all that name one value are within one bit of it, so within two of each other: 17 fingerprints at most
    stars = (named.groupBy("k", "j", "name").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all"))
             .where(F.size("all") > 1).select("u", F.explode("all").alias("v")).where("u <> v"))
    return pairs.union(stars).distinct()


def entry_rows(fps: DataFrame) -> DataFrame:
    """``way, entries, rows`` of distinct ``fp`` values: tallied, split and tallied, or named."""
    entries, _, split, _ = _index(fps)
    rows = (entries.where(F.col("n") <= ENTRY_PAIRS_MAX).select(F.lit("tallied").alias("way"), "n")
            .union(split.select(F.when(F.col("n") <= ENTRY_PAIRS_MAX, "split").otherwise("named").alias("way"), "n")))
    return rows.groupBy("way").agg(F.round(F.sum(1 / F.col("n"))).cast("long").alias("entries"), F.count("*").alias("rows"))


def components(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(order, fp)`` rows -> ``(fp, component_id)``, one row per fingerprint; the id is the smallest ``order`` value."""
    fps = materialize(rows.groupBy("fp").agg(F.min(order).alias("low")))
    cc = connected_components(links(fps.select("fp")))
    rooted = fps.join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = stored(fingerprints(df, text, shingle))
    comp = components(rows)
    return (rows.join(comp, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(df: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` with one row of each component: the smallest doc_id (nulls last; among repeated ids, one of them)."""
    uid = free_name(df, "row_uid")
    base = stored(df.withColumn(uid, F.monotonically_increasing_id()))
    rows = stored(fingerprints(base, text, shingle, ["doc_id", uid]).withColumnRenamed(uid, "uid"))
    comp = components(rows, "uid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    keep = rows.join(comp, "fp").groupBy("component_id").agg(first.alias("f")).select(F.col("f.uid").alias(uid))
    return base.join(keep, uid, "left_semi").drop(uid)
