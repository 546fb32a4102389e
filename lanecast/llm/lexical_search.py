"""Ranked lexical search with the Best Position Algorithm, over impact lists of bounded document blocks.

1. One pass over the whole texts stores, per document with a term, its length ``n`` and its counts of the searched
   terms. The corpus counts (documents ``N``, length ``L``, document frequencies) are added up from that table.
2. Each task cuts its documents into blocks of ``BLOCK_DOCS`` documents or ``BLOCK_POSTINGS`` postings. A block has one
   impact list per term, sorted by impact, and the same postings by document for direct accesses.
3. Each item searches a block by the Best Position Algorithm: its lists are read in parallel, ``STEP`` positions at a
   time; each new document gets its whole score by direct accesses, which mark the positions where they hit as seen.
   The best position of a list is the last one of its unbroken run of seen positions from the start. The threshold is
   the sum of the impacts there: no unseen document scores more. The search stops when the threshold is strictly
   below the k-th score, so documents that tie with it are still scored. The best k of an item carry over from block to
   block within a task.
4. The tasks' best k are merged in two steps, by item and a part of the ids, then by item.

Postings are never shuffled, so a term that a third of all documents hold stays spread over all tasks. Items are read
in blocks of at most ``BLOCK_TERMS`` terms (or one item); each block is one pass over the documents.

Defined results: null texts and texts without a term are in no list and not counted; repeated rows of documents or of
items count and are ranked as rows; a null doc_id ranks after all others of its score; items without a scoring
document give no row. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanecast.llm.common import free_name, map_rows, stored, word_pieces

TOP = 20
# Fixed by the contract: bytes of terms (ASCII letters and digits, and all bytes of other characters), A-Z lower-cased.
TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Distinct terms of a block of items.
BLOCK_TERMS = 200_000
BLOCK_DOCS = 16_384
BLOCK_POSTINGS = 1_500_000
STEP = 64
#: Parts of the ids in the first merge.
MERGE_PARTS = 64


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists."""
    return word_pieces((text or "").encode("utf-8", "surrogatepass").translate(TERMS))


def item_blocks(items: DataFrame, text: str, most: int = BLOCK_TERMS) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """Blocks of ``(item_id, counts of its terms)``."""
    block, known = [], set()
    for r in items.select("item_id", F.col(text).alias("t")).toLocalIterator():
        wanted: Counter = Counter()
        for piece in terms(r.t):
            wanted.update(piece)
        if not wanted:
            continue
        if block and len(known | wanted.keys()) > most:
            yield block
            block, known = [], set()
        block.append((r.item_id, dict(wanted)))
        known |= wanted.keys()
    if block:
        yield block


def postings(df: DataFrame, number: dict[bytes, int], text: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts`` of the documents with a term; ``terms`` are numbers of searched terms, ascending."""
    def row(doc_id, t):
        import numpy as np

        n, found = 0, []
        for piece in terms(t):
            n += len(piece)
            found.append(np.unique(np.array([number[x] for x in piece if x in number], np.int64), return_counts=True))
        if len(found) > 1:
            k, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            found = [(k, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64))]
        k, c = found[0] if found else ((), ())
        return doc_id, n, list(k), list(c)

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"))
    return map_rows(docs, row, "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0")


class Block:
    """The impact lists of some documents."""

    def __init__(self, ids: list, lengths: list[int], terms: list, counts: list, n_docs: int, n_terms: int):
        import numpy as np

        self.none = np.array([i is None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        sizes = [len(x) for x in terms]
        doc = np.repeat(np.arange(len(ids)), sizes)
        term = np.concatenate([np.asarray(x, np.int64) for x in terms])
        tf = np.concatenate([np.asarray(x, np.int64) for x in counts])
        m = 100 - 25 + (25 * np.array(lengths, np.int64) * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        by_doc = np.argsort(term, kind="stable")          # documents are in order already
        by_impact = np.lexsort((doc, -impact, term))
        place = np.empty(len(term), np.int64)
        place[by_impact] = np.arange(len(term))
        self.list_doc, self.list_impact = doc[by_impact], impact[by_impact]
        self.doc, self.impact, self.place = doc[by_doc], impact[by_doc], place[by_doc]
        kinds, first, size = np.unique(term[by_doc], return_index=True, return_counts=True)
        self.lists = {int(k): (int(a), int(a + n)) for k, a, n in zip(kinds, first, size)}

    def search(self, wanted: list[tuple[int, int]], best: Best, step: int = STEP) -> int:
        """Adds the block's documents that can be among the ``best`` of an item; ``wanted`` has (term, weight).

        Returns how many documents were scored.
        """
        import numpy as np

        lists = [(*self.lists[t], w) for t, w in wanted if w and t in self.lists]
        if not lists:
            return 0
        seen = np.zeros(len(self.ids), bool)
        passed = [np.zeros(stop - start, bool) for start, stop, _ in lists]
        edge = [0] * len(lists)          # best positions
        depth, scored = 0, 0
        while True:
            rows = [self.list_doc[start + depth:min(start + depth + step, stop)] for start, stop, _ in lists]
            new = np.unique(np.concatenate(rows))
            new = new[~seen[new]]
            seen[new] = True
            scores = np.zeros(len(new), np.int64)
            bound = 0
            for i, (start, stop, w) in enumerate(lists):
                passed[i][depth:depth + step] = True
                if len(new):
                    held = self.doc[start:stop]
                    at = np.minimum(np.searchsorted(held, new), stop - start - 1)
                    hit = held[at] == new
                    at = at[hit] + start
                    scores[hit] += w * self.impact[at]
                    passed[i][self.place[at] - start] = True
                rest = passed[i][edge[i]:]
                ahead = int(rest.argmin()) if len(rest) else 0
                edge[i] = len(passed[i]) if len(rest) and rest[ahead] else edge[i] + ahead
                if edge[i] < stop - start:
                    bound += w * int(self.list_impact[start + edge[i] - 1])
            best.add(scores, self.none[new], self.ids[new])
            scored += len(new)
            depth += step
            if bound == 0 or bound < best.kth():
                return scored


class Best:
    """The best k documents of an item so far: highest score, then ids in order, then no id."""

    def __init__(self, k: int):
        import numpy as np

        self.k = k
        self.scores, self.none, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores, none, ids) -> None:
        import numpy as np

        ok = (scores > 0) & (scores >= self.kth())
        if not ok.any():
            return
        s, o, i = (np.concatenate(x) for x in ((self.scores, scores[ok]), (self.none, none[ok]), (self.ids, ids[ok])))
        order = np.lexsort((i, o, -s))[:self.k]
        self.scores, self.none, self.ids = s[order], o[order], i[order]


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", block_terms: int = BLOCK_TERMS,
           block_docs: int = BLOCK_DOCS, step: int = STEP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 of each item."""
    id_type = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in item_blocks(items, text, block_terms):
        found = _search_block(docs, block, id_type, k, text, block_docs, step)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return out


def _search_block(docs, block, id_type, k, text, block_docs, step) -> DataFrame:
    number = {t: i for i, t in enumerate(sorted({t for _, wanted in block for t in wanted}))}
    held = stored(postings(docs, number, text))
    n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
    df = {r.t: r.n for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    asked = [(i, [(number[t], r * weight(df[number[t]], n_docs)) for t, r in wanted.items() if number[t] in df])
             for i, (_, wanted) in enumerate(block)]

    def run(batches):
        import pyarrow as pa

        best = [Best(k) for _ in asked]
        ids, lengths, terms, counts, size = [], [], [], [], 0

        def searched():
            b = Block(ids, lengths, terms, counts, n_docs, n_terms)
            for i, wanted in asked:
                b.search(wanted, best[i], step)

        for b in batches:
            for doc_id, n, t, c in zip(*(x.to_pylist() for x in b.columns)):
                if not t:
                    continue
                ids.append(doc_id)
                lengths.append(n)
                terms.append(t)
                counts.append(c)
                size += len(t)
                if len(ids) >= block_docs or size >= BLOCK_POSTINGS:
                    searched()
                    ids, lengths, terms, counts, size = [], [], [], [], 0
        if ids:
            searched()
        schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
        for i, top in enumerate(best):
            if len(top.scores):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(top.scores), pa.int32()),
                                                  pa.array(top.ids, pa.int64(), mask=top.none),
                                                  pa.array(top.scores, pa.int64())], schema=schema)

    rows = held.mapInArrow(run, "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = free_name(rows, "part")
    rows = rows.withColumn(part, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(MERGE_PARTS)))
    for keys in (["item", part], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {id_type}")
    return rows.join(names, "item").select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of the query: full scoring of every document, without the algorithm.
ORACLE = f"""
WITH tok AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
d AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM tok WHERE len(ts) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
qc AS (SELECT i, item_id, t, CAST(count(*) AS BIGINT) AS qn FROM q GROUP BY i, item_id, t),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d)
      WHERE t IN (SELECT t FROM qc) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT t, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY t), corpus),
s AS (SELECT i, item_id, p.r, doc_id, CAST(sum(qn * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))
      AS BIGINT) AS score FROM qc JOIN p USING (t) JOIN w USING (t) JOIN d ON d.r = p.r, corpus GROUP BY i, item_id, p.r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank,
      doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
