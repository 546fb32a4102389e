"""Benchmark decontamination: size-partitioned MinHash containment search of items in documents [native].

Items are partitioned by their number of shingles q: class c holds GROWTH ** c <= q < GROWTH ** (c + 1). Each class
has its own windows, ``hi + step`` shingles long (hi the largest q of the class) with a step of ``hi / 4``, so that an
item that stands in a document lies whole in some window and fills at least ``1 / (1.25 * GROWTH)`` of it, whatever
the length of the document. See ``shingle_search`` for the sketch, the collision bound and the exact check.

Defined results: one row per document and item of which at least 80 % of the distinct shingles stand in the document;
rows that repeat a doc_id give one row, with the largest share; null or short texts (under five words) contain nothing,
and items with a null id or under five words are not searched (they have no shingle). A null doc_id is reported as
null. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import free_name
from lanecast.llm.shingle_search import CONTAINMENT, row_keys, search, sketches, target_shingles
from lanecast.session import materialize

#: Ratio of the largest to the smallest item of a size class.
GROWTH = 1.5


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Leaked items with the row keys of the documents that hold them."""
    shingles = materialize(target_shingles(items, "item_id"))
    pieces = materialize(sketches(shingles.withColumn("piece", F.lit(0)), GROWTH))
    return search(docs, shingles, pieces, text, containment)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, item_id, item_shingles, shared, containment``: one row per document and leaked item."""
    return (leaks(docs, items, text).groupBy("doc_id", F.col("target").alias("item_id"))
            .agg(F.max("shingles").alias("item_shingles"), F.max("shared").alias("shared"))
            .withColumn("containment", F.col("shared") / F.col("item_shingles")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns unchanged."""
    a, b = free_name(docs, "key_a"), free_name(docs, "key_b")
    k1, k2 = row_keys(F.col(text), F.col("doc_id"))
    bad = leaks(docs, items, text).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return docs.withColumns({a: k1, b: k2}).join(bad, [a, b], "left_anti").drop(a, b)


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM iw)),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, g FROM
      (SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM
       (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw))
      WHERE g IN (SELECT g FROM i)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles
"""
