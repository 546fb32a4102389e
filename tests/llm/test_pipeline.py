import hashlib
import random
import re

import pytest

import corpus_pipeline
from lanecast.llm import bpe, quality, secrets
from tests.llm.test_containment import contained
from tests.llm.test_simhash import classes, plain_simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, make_docs, edge_texts):
    """The smallest tables with rows added: nulls, repeats, a benchmark passage and a secret in good prose."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    good = docs.join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id")
    prose = good.where("n_chars between 2000 and 4000 and lang = 'en'").orderBy("doc_id").first().text
    half = len(prose) // 2
    rows = [(90001, prose[:half] + " " + bench.orderBy("item_id").first().text + " " + prose[half:]),
            (90002, prose[half:] + ' token = "abcdefghijkl" ' + prose[:half]), (None, prose[half:]), *edge_texts]
    docs.union(make_docs(rows)).write.parquet(f"{d}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return d


def test_pipeline_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = sorted(((r.doc_id, r.text) for r in quality.keep_good(docs, labels).select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_simhash(t) for _, t in rows]
    low, seen, kept = classes(fps), set(), []
    for f, row in zip(fps, rows):
        if low[f] not in seen:
            seen.add(low[f])
            kept.append(row)
    kept = [(i, t) for i, t in kept if not contained([(0, t)], items)]
    coder = bpe.codec(bpe.vocabulary_path())
    want = []
    for i, t in kept:
        t, at, out = t or "", 0, []
        for _, a, b, _ in secrets.base_spans(t):
            if a >= at:
                out += [t[at:a], "[REDACTED]"]
            at = max(at, b)
        t = "".join([*out, t[at:]])
        ids = coder.encode(t)
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 90001 not in {w[0] for w in want}


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), tables).count() == 0


def test_secrets_leave_no_value(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean = corpus_pipeline.secret_stage(spark, docs, tables)
    assert not [r for r in clean.select("text").collect() if r.text and re.search("abcdefghijkl", r.text)]
    assert clean.count() == docs.count()


def test_learnt_formats_are_redacted(spark, make_docs):
    """Keys without a keyword go as well, once their format is learnt from those that have one; other tokens stay."""
    rng = random.Random(21)
    key = lambda: "ghp_" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    labelled, alone = [key() for _ in range(30)], [key() for _ in range(20)]
    kept = ["4111111111111111", "Donaudampfschifffahrtsgesellschaft", "3f2b8c1e-9d4a-4f6b-8a7c-1e2d3f4a5b6c"]
    texts = [(i, f"set token = {k} and internationalization {kept[i % 3]} here") for i, k in enumerate(labelled)]
    texts += [(100 + i, f"once {k}. Then {kept[i % 3]}.") for i, k in enumerate(alone)]
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_stage(spark, make_docs(texts), "").collect()}
    assert sum(k in got[100 + i] for i, k in enumerate(alone)) <= 2          # recall 0.9 at least
    assert not any(k in got[i] for i, k in enumerate(labelled))
    assert all(kept[i % 3] in got[d] for i, d in [*enumerate(range(30)), *enumerate(range(100, 120))])
