import random
import re

import pytest

from lanecast.llm import decontaminate, licenses, shingle_search
from lanecast.llm.common import table


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}


def contained(docs, items):
    best = {}
    for i, t in docs:
        for k, x in items:
            g = grams(x)
            n = len(g & grams(t))
            if g and k is not None and n >= 0.8 * len(g):
                best[(i, k)] = (len(g), max(n, best.get((i, k), (0, 0))[1]))
    return sorted(((i, k, n, s) for (i, k), (n, s) in best.items()), key=str)


@pytest.fixture(scope="module")
def planted():
    """Items of 3 to 120 words in documents: whole, with words changed, in half, repeated, at either end."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([3, 4, 5, 6, 7, 9, 12, 15, 22, 30, 41, 60, 90, 120])]
    items += [(50, items[9][1]), (51, None), (None, say(20)), (52, " ")]
    docs = []
    for k, text in items[:14]:
        w = text.split()
        changed = list(w)
        changed[len(w) // 2] = "changed"
        docs += [(len(docs), f"{say(rng.randrange(900))} {text.upper()}, {say(rng.randrange(90))}"),
                 (len(docs) + 1, text), (len(docs) + 2, " ".join(changed) + " " + say(50)),
                 (len(docs) + 3, say(30) + " " + " ".join(w[:len(w) // 2])),
                 (len(docs) + 4, (say(7) + ". " + text + "! ") * 3)]
    docs += [(1000, docs[0][1]), (1000, docs[0][1]), (1001, docs[45][1]), (1001, "no such words"), (None, docs[45][1]),
             (None, None), (1002, None), (1003, ""), (1004, say(60_000) + " " + items[10][1])]
    return docs, items


@pytest.mark.parametrize("block", [250_000, 50])
def test_items_in_documents(spark, make_docs, planted, monkeypatch, block):
    monkeypatch.setattr(shingle_search, "BLOCK_ENTRIES", block)
    docs, items = planted
    known = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(make_docs(docs, clash=True), known).collect()
    assert sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got), key=str) == contained(docs, items)
    assert all(r.containment == r.shared / r.item_shingles for r in got)


def test_one_shingle_between_smaller_hashes_is_found(spark, make_docs):
    """Both neighbours of the notice have smaller hashes in its bin, so it is the least of no longer window."""
    from pyspark.sql import functions as F

    notice = "zeta yellow xenon wolf violet".split()
    words = spark.range(6000).select(F.concat(F.lit("w"), "id").alias("w"))
    h = lambda ws: F.xxhash64(*ws)
    said = [F.lit(x) for x in notice]
    own = h(said)
    beside = lambda other: words.where((F.pmod(other, F.lit(shingle_search.BINS)) == F.pmod(
        own, F.lit(shingle_search.BINS))) & (other < own)).first().w
    before, after = beside(h([F.col("w"), *said[:4]])), beside(h([*said[1:], F.col("w")]))
    docs = make_docs([(1, " ".join(["some", "more", before, *notice, after, "and", "others"]))])
    known = spark.createDataFrame([(5, " ".join(notice))], "item_id long, text string")
    got = decontaminate.contaminated(docs, known).collect()
    assert [(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got] == [(1, 5, 1, 1)]


def test_rows_with_items_go(spark, make_docs, planted):
    docs, items = planted
    known = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs(docs, clash=True)
    got = decontaminate.drop_contaminated(df, known)
    assert got.columns == df.columns
    want = [(i, t) for i, t in docs if not contained([(0, t)], items)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def scattered():
    """Items of 9 to 300 words whose shingles stand far apart in 1,500 documents: parts of an item in any order between
    other words, so that about 80 % of its shingles are there; more items share one part, one item is very long."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    say = lambda n: [word() for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate([9, 12, 16, 20, 25, 31, 40, 55, 80, 120, 200, 300] * 5)]
    items.append((99, say(4000)))
    docs = []
    for i in range(1500):
        w = items[i % 61][1]
        parts = max(1, min(len(w) // 25, 12))
        drop = int(0.2 * (len(w) - 4)) - 4 * (parts - 1)   # each border between two parts loses four shingles
        w = w[max(0, drop - rng.randrange(2)):]
        cuts = [len(w) * j // parts for j in range(parts + 1)]
        order = rng.sample(range(parts), parts)
        text = say(rng.randrange(20, 200))
        for j in order:
            text += w[cuts[j]:cuts[j + 1]] + say(rng.randrange(20, 200))
        docs.append((i, " ".join(text)))
    return docs, [(k, " ".join(w)) for k, w in items]


def test_recall_of_scattered_shingles(spark, make_docs, scattered):
    """Retrieval by sketches alone against exact containment, where shared shingles lie windows apart."""
    docs, items = scattered
    own = {k: grams(x) for k, x in items}
    want = set()
    for i, t in docs:
        held = grams(t)
        want |= {(i, k) for k, g in own.items() if len(g & held) >= 0.8 * len(g)}
    shares = [len(own[k] & grams(docs[i][1])) / len(own[k]) for i, k in sorted(want)]
    assert len(want) > 500 and sum(x < 0.9 for x in shares) > 400
    known = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make_docs(docs), known).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_only_retrieved_documents_are_read_for_all_shingles(spark, make_docs, scattered, monkeypatch):
    """The first join holds sketch entries alone, the second the retrieved documents alone."""
    docs, items = scattered
    seen = []
    at = shingle_search._at_entries
    monkeypatch.setattr(shingle_search, "_at_entries", lambda r, h: seen.append((r.count(), h.count())) or at(r, h))
    others = [(5000 + i, f"no item stands here number {i} of them") for i in range(300)]
    known = spark.createDataFrame([x for x in items if x[0] == 99], "item_id long, text string")
    assert decontaminate.contaminated(make_docs(docs + others), known).count() >= 20
    (all_docs, entries), (retrieved, wanted) = seen
    assert all_docs == 1800 and entries <= shingle_search.BINS and retrieved < 60 and wanted == 3996


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "some words of a document here")])
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    some = spark.createDataFrame([(1, "some words of a document")], "item_id long, text string")
    assert decontaminate.contaminated(make_docs([]), some).count() == 0
    assert licenses.scan(make_docs([]), licenses.templates(spark)).count() == 0


def test_hot_passage_and_copies(spark, make_docs):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(900)] + [(i, passage) for i in
                                                                                  range(900, 1200)]
    items = [(k, passage + f" tail{k}") for k in range(3)]
    got = decontaminate.contaminated(make_docs(texts), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 3600 and got.agg({"shared": "min"}).first()[0] == 36


def test_licences(spark, make_docs):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choices(["ab", "cde", "fg", "hij", "k"], k=n))
    docs = []
    for text in licenses.TEMPLATES.values():
        w = text.split()
        docs += [(len(docs), f"{say(400)}\n{text}\n{say(90)}"), (len(docs) + 1, text.upper()),
                 (len(docs) + 2, " ".join(w[:len(w) // 2]))]
    docs += [(500, None), (501, ""), (None, licenses.TEMPLATES["MIT"]), (0, docs[0][1]),
             (502, " ".join(licenses.TEMPLATES.values()))]
    got = licenses.scan(make_docs(docs, clash=True), licenses.templates(spark)).collect()
    want = contained(docs, list(licenses.TEMPLATES.items()))
    assert sorted(((r.doc_id, r.license, r.license_shingles, r.shared) for r in got), key=str) == want


def test_queries_equal_sql(spark):
    import duckdb

    from lanecast.llm.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for key in ("op9_license_scans", "op10_decontaminate"):
        got = QUERIES[key](spark, d).toPandas()
        want = con.execute(ORACLES[key]).df()[list(got.columns)]
        assert len(got) and sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want.to_numpy()))


def test_plans_have_no_python(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    found = decontaminate.leaks(docs, table(spark, d, "benchmark"))
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
