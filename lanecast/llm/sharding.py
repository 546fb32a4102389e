"""Sharding by bytes: Karmarkar-Karp differencing over groups of equal texts.

Equal texts are one indivisible group. A partial partition has one load per shard; the two with the largest spread
are combined, the heaviest load of one with the lightest of the other, until one is left. No task holds all groups:
while there are more than ``TASK_ITEMS``, they are dealt to tasks by a hash, and each task differences its items into
bundles, which are the items of the next level. Bundles come in tiers of halving size, so that the last level has
heavy ones to set against heavy groups and light ones to even out the rest. Items above 1/128 of a fair share pass to
the next level as they are (at most 128 per shard), and one task differences the last ``TASK_ITEMS`` at most.

A group with more bytes than a whole shard's fair share cannot stay whole without breaking the balance. Only such
groups (fewer than there are shards) are dealt by row into pieces of a quarter of the fair share, by a hash of the id.

Groups are numbered by a hash of their text, so the result follows from the rows alone, whatever their order and
partitions. Groups that the hash takes for one stay together.

Defined results: a null text counts as empty (size 1) and is grouped with empty ones; every row gets one slot, repeated
rows and repeated or null ids included; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanecast.llm.common import stored
from lanecast.session import materialize

SHARDS = 16
TASK_ITEMS = 20_000
TIERS = 8
TIER_BUNDLES = 32
LARGE = 128
PIECES_PER_SHARE = 4
SLOT_ROWS = 100_000


def differencing(sizes: list[int], ways: int) -> list[int]:
    """The slot (0 to ``ways`` - 1) of each item, by repeatedly combining the two partials of largest spread."""
    heap = [(-x, i, [(x, i)] + [(0, None)] * (ways - 1)) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x + y, u if t is None else t if u is None else (t, u))
                       for (x, t), (y, u) in zip(a, reversed(b))), key=lambda t: -t[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], made, both))
        made += 1
    out = [0] * len(sizes)
    for slot, (_, tree) in enumerate(heap[0][2] if heap else []):
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                out[x] = slot
    return out


def _bundles(items: DataFrame, tasks: int, large: float) -> DataFrame:
    """``(item, bytes)`` -> ``(item, up)``: the bundle of each item; large ones are their own (negative numbers)."""
    def bundle(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        out = []
        for tier, part in pdf.groupby("tier"):
            slots = differencing([int(x) for x in part.bytes], TIER_BUNDLES)
            out.append(part[["item"]].assign(up=[(int(key[0]) * TIERS + int(tier)) * TIER_BUNDLES + s for s in slots]))
        return pd.concat(out)

    draw = F.pmod(F.xxhash64("item", F.lit(2)), F.lit(1 << TIERS))
    tier = F.lit(0)
    for t in range(1, TIERS):  # a half in tier 0, a quarter in tier 1, ...
        tier = F.when(draw < (1 << TIERS - t), t).otherwise(tier)
    small = (items.where(F.col("bytes") <= large)
             .select("item", "bytes", F.pmod(F.xxhash64("item"), F.lit(tasks)).alias("task"), tier.alias("tier"))
             .groupBy("task").applyInPandas(bundle, "item long, up long"))
    return small.union(items.where(F.col("bytes") > large).select("item", (-F.col("item") - 1).alias("up")))


def deal(items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(item, bytes)`` with distinct long items -> ``(item, shard)``."""
    r = items.agg(F.count("*").alias("n"), F.sum("bytes").alias("s")).first()
    n, large = r.n, (r.s or 0) / shards / LARGE
    maps = []
    while n > TASK_ITEMS:
        up = stored(_bundles(items, math.ceil(n / TASK_ITEMS), large))
        maps.append(up)
        items = materialize(items.join(up, "item").groupBy(F.col("up").alias("item")).agg(F.sum("bytes").alias("bytes")))
        before, n = n, items.count()
        if n >= before:
            raise ValueError("the items do not get fewer: TASK_ITEMS is below what one level passes on")

    def last(pdf):
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        return pdf[["item"]].assign(shard=differencing([int(x) for x in pdf.bytes], shards))

    # at most TASK_ITEMS rows, as checked above
    out = items.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(last, "item long, shard int")
    for up in reversed(maps):
        out = up.join(out.withColumnRenamed("item", "up"), "up").select("item", "shard")
    return out


def shard(df: DataFrame, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (law ``bytes``)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(df.select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"),
                            (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
                  .withColumn("row", F.xxhash64("doc_id", "digest")))
    totals = rows.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    share = (totals.s or 0) / shards
    whole = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    # each of these has more than one of ``shards`` fair shares, so there are fewer than ``shards``: bounded to broadcast
    heavy = whole.where(F.col("bytes") > share).select(
        "digest", F.ceil(F.col("bytes") / F.lit(max(share / PIECES_PER_SHARE, 1.0))).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(heavy), "digest", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"), F.lit(0))).drop("pieces")
    pieces = (rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest", "piece")
              .agg(F.sum("size").alias("bytes")))
    groups = stored(whole.where(F.col("bytes") <= share).select("digest", F.lit(0).alias("piece"), "bytes")
                    .union(pieces).withColumn("item", F.xxhash64("digest", "piece").bitwiseAND(F.lit((1 << 62) - 1))))
    items = materialize(groups.groupBy("item").agg(F.sum("bytes").alias("bytes")))
    to = groups.join(deal(items, shards), "item").select("digest", "piece", "shard")
    chunks = max(1, math.ceil(totals.n / SLOT_ROWS))
    placed = stored(rows.join(to, ["digest", "piece"])
                    .select("doc_id", "digest", "size", "text_crc32", "shard",
                            F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).alias("chunk")))
    before = (Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
               .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "digest")
    return (placed.withColumn("at", F.row_number().over(order)).join(offsets, ["shard", "chunk"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
