"""A stored, versioned index of the lane knowledge base, joined by batch quotes and streams alike.

``stored_index`` writes one folder per content of the knowledge base, once; whoever comes later with the same lanes opens
it.  The folder holds

- ``lanes``: the knowledge base itself, for exact keys;
- ``postings``: (side, gram, k_ok, k_dk), the lanes whose origin (side ``o``) or destination (``d``) key has the gram;
- ``grams``: (side, gram, n), the length of each list;
- ``fallback``: the averages over all trips (one row);
- ``_COMMITTED``, written last: a folder without it is built anew.

Grams are the substrings of one to three characters.  A gram with more than ``LIST_MAX`` lanes is split: its extensions
by the next character are indexed too, and theirs, up to ``GRAM_MAX`` characters.  So a name of three characters or more
is looked up through a list of ``LIST_MAX`` lanes at most, unless more lanes hold its rarest ``GRAM_MAX`` characters (or
all of it).  Postings are partitioned by a hash of the gram, so that the planner can prune to the grams asked for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast import constants as K
from lanecast.session import ensure_checkpoint_dir

LANE_CTX = ["lane_popularity", "route_risk", "driver_delay_rate", "trip_count", "avg_dist_km"]
GRAM = 3
GRAM_MAX = 12
LIST_MAX = 1000
BUCKETS = 32
MARK = "_COMMITTED"
_CONTEXT = ", ".join(f"{c} {'long' if c == 'trip_count' else 'double'}" for c in LANE_CTX)
#: Fixed schemas, so that opening an index runs no job.
SCHEMAS = {"lanes": f"ok string, dk string, {_CONTEXT}", "fallback": _CONTEXT, "grams": "side string, gram string, n long",
           "postings": "side string, gram string, k_ok string, k_dk string, bucket int"}


def substrings(name: Column, shortest: int, longest: int) -> Column:
    """Distinct substrings of ``shortest`` to ``longest`` characters."""
    n = F.length(name)

    def of_length(k: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), n - F.lit(k - 1)), lambda i: F.substring(name, i, F.lit(k)))
        return F.when(n >= k, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_length(k) for k in range(shortest, longest + 1)]))


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class LaneIndex:
    """An index folder, opened; every table is read from storage."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    @property
    def lanes(self) -> DataFrame:
        return self._table("lanes")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def grams(self) -> DataFrame:
        return self._table("grams")

    @property
    def fallback(self) -> DataFrame:
        return self._table("fallback")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def kb_version(kb: DataFrame, fallback: DataFrame) -> str:
    """A digest of the lanes and averages that does not depend on their order."""
    cells = F.xxhash64(*[F.col(c).cast("string") for c in ["ok", "dk", *LANE_CTX]], *[F.col(c).isNull() for c in LANE_CTX])
    rows = kb.agg(F.count("*"), F.sum(cells.cast("decimal(38,0)")), F.bit_xor(cells)).first()
    held = [LIST_MAX, GRAM, GRAM_MAX, BUCKETS, *rows, *fallback.select(*LANE_CTX).collect()]
    return hashlib.md5(repr(held).encode()).hexdigest()


def stored_index(kb: DataFrame, fallback: DataFrame, root: str | None = None) -> LaneIndex:
    """The index of ``kb`` (one row per (ok, dk)) below ``root`` (default: the shared checkpoint folder), built if absent."""
    spark = kb.sparkSession
    root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lane-index").rstrip("/")
    index = LaneIndex(spark, f"{root}/{kb_version(kb, fallback)}")
    fs, mark = _file(spark, f"{index.path}/{MARK}")
    if not fs.exists(mark):
        build(index, kb, fallback)
        fs.create(mark, True).close()
    return index


def build(index: LaneIndex, kb: DataFrame, fallback: DataFrame, list_max: int = LIST_MAX) -> None:
    """Writes the tables of an index; what an earlier, broken build left there is overwritten."""
    context = [F.col(c).cast("long" if c == "trip_count" else "double") for c in LANE_CTX]
    kb.select("ok", "dk", *context).write.mode("overwrite").parquet(f"{index.path}/lanes")
    fallback.select(*context).write.mode("overwrite").parquet(f"{index.path}/fallback")
    lanes = index.lanes.select(F.col("ok").alias("k_ok"), F.col("dk").alias("k_dk"))

    def keyed(side: str, shortest: int, longest: int) -> DataFrame:
        grams = substrings(F.col("k_ok" if side == "o" else "k_dk"), shortest, longest)
        return lanes.select(F.lit(side).alias("side"), F.explode(grams).alias("gram"), "k_ok", "k_dk")

    def put(rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn("bucket", gram_bucket(F.col("gram")))
        (rows.repartition("bucket", "gram").sortWithinPartitions("bucket", "gram")
         .write.mode(mode).partitionBy("bucket").parquet(f"{index.path}/postings"))

    put(keyed("o", 1, GRAM).unionByName(keyed("d", 1, GRAM)), "overwrite")
    for length in range(GRAM, GRAM_MAX):
        hot = (index.postings.where(F.length("gram") == length).groupBy("side", "gram").agg(F.count("*").alias("n"))
               .where(F.col("n") > list_max).select("side", F.col("gram").alias("start")))
        if hot.isEmpty():
            break
        longer = keyed("o", length + 1, length + 1).unionByName(keyed("d", length + 1, length + 1))
        start = F.substring(F.col("gram"), 1, length)
        put(longer.withColumn("start", start).join(hot, ["side", "start"], "left_semi").drop("start"), "append")
    (index.postings.groupBy("side", "gram").agg(F.count("*").alias("n"))
     .write.mode("overwrite").parquet(f"{index.path}/grams"))


def probes(pairs: DataFrame, index: LaneIndex) -> DataFrame:
    """``ok, dk, side, gram, n``: the shortest list through which a pair of names is looked up.

    The grams of both names compete.  A pair one of whose names has a gram of up to three characters that no lane has on
    that side is left out: no lane contains it.  So are empty names (blank names are rejected before, see B4).
    """
    def own(name: str, side: str) -> Column:
        c = F.col(name)
        grams = F.when(F.length(c) < GRAM, F.array(c)).otherwise(substrings(c, GRAM, GRAM_MAX))
        return F.transform(grams, lambda g: F.struct(F.lit(side).alias("side"), g.alias("gram")))

    asked = (pairs.where((F.length("ok") > 0) & (F.length("dk") > 0))
             .select("ok", "dk", F.explode(F.concat(own("ok", "o"), own("dk", "d"))).alias("p"))
             .select("ok", "dk", "p.side", "p.gram"))
    found = asked.join(index.grams, ["side", "gram"], "left")
    absent = F.col("n").isNull() & (F.length("gram") <= GRAM)
    return (found.groupBy("ok", "dk").agg(F.min(F.when(F.col("n").isNotNull(), F.struct("n", "side", "gram"))).alias("p"),
                                          F.max(absent).alias("absent"))
            .where(~F.col("absent") & F.col("p").isNotNull()).select("ok", "dk", "p.side", "p.gram", "p.n"))


def candidates(pairs: DataFrame, index: LaneIndex) -> DataFrame:
    """``ok, dk, k_ok, k_dk``: the lanes of each pair's list.  They carry both keys, so no second list is read."""
    asked = probes(pairs, index).withColumn("bucket", gram_bucket(F.col("gram")))
    return asked.join(index.postings, ["bucket", "side", "gram"]).select("ok", "dk", "k_ok", "k_dk")


def contains_matches(pairs: DataFrame, index: LaneIndex) -> DataFrame:
    """C2 on distinct (ok, dk): ``_first``, the least lane key pair whose keys contain both names, where there is one."""
    return (candidates(pairs, index)
            .where(F.col("k_ok").contains(F.col("ok")) & F.col("k_dk").contains(F.col("dk")))
            .groupBy("ok", "dk").agg(F.min(F.struct("k_ok", "k_dk")).alias("_first")))


def global_context(fallback: DataFrame) -> Column:
    """The averages over all trips (one aggregate row) as a scalar subquery; without any trip, constants."""
    return fallback.select(F.struct(*[F.coalesce(c, F.lit(K.NO_KB_GLOBAL[c])).alias(c) for c in LANE_CTX])
                           .alias("g")).scalar()
