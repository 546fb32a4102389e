import random
import zlib

import numpy as np
import pytest

from lanecast.llm import language, quality
from lanecast.llm.common import table

DATA = "/root/testdata/sf0.01"


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# ---- 4: language

def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in language.new_network(3, hidden=4).items()}
    codes, y = rng.integers(97, 105, (5, 6)), np.array([0, 1, 2, 0, 1])

    def loss(n):
        p = language.label(n, codes)
        return -np.log(p[np.arange(5), :, y]).mean()

    before = {k: v.copy() for k, v in net.items()}
    f, saved = language._gru(codes, net["xf"], net["uf"], net["cf"], True)
    b, saved_b = language._gru(codes[:, ::-1], net["xb"], net["ub"], net["cb"], True)
    p = language.label(net, codes)
    p[np.arange(5), :, y] -= 1
    ds = p / 30 @ net["v"].T
    g = {k: np.zeros_like(v) for k, v in net.items()}
    language._gru_back(codes, net["uf"], saved, [ds[:, t, :4] for t in range(6)], g["xf"], g["uf"], g["cf"])
    language._gru_back(codes[:, ::-1], net["ub"], saved_b, [ds[:, 5 - t, 4:] for t in range(6)], g["xb"], g["ub"],
                       g["cb"])
    for k, at in (("xf", (99, 2)), ("xf", (100, 9)), ("uf", (1, 5)), ("cf", (10,)), ("ub", (2, 11)), ("xb", (98, 0))):
        moved = {**before, k: before[k].copy()}
        moved[k][at] += 1e-3
        lower = {**before, k: before[k].copy()}
        lower[k][at] -= 1e-3
        assert (loss(moved) - loss(lower)) / 2e-3 == pytest.approx(g[k][at], rel=0.02, abs=1e-5)


def test_languages_of_held_out_documents(spark):
    docs = table(spark, DATA, "documents")
    got = language.detect(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert list(got.held_out) == [out(i) for i in got.doc_id]
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_pooling_counts_every_position():
    net = language.new_network(3)
    texts = ["ab cd ab ab", "x" * 200 + " yy", "", None]
    got = language.pooled(net, 3, texts)
    for t, p in zip(texts, got):
        parts = language.segments((t or "").encode())
        rows = [language.label(net, np.frombuffer(s, np.uint8)[None, :])[0] for s in parts]
        want = np.concatenate(rows).mean(axis=0) if rows else np.zeros(3)
        assert np.allclose(p, want, atol=1e-5)


def test_segments_are_cut_between_characters():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("ax\u00e9\u0416\u6f22\U0001f600", k=rng.randrange(1, 120)))
        parts = language.segments(text.encode())
        assert b"".join(parts) == text.encode() and max(map(len, parts)) <= language.SEGMENT
        assert "".join(p.decode() for p in parts) == text
        assert all(len(p) > language.SEGMENT - 4 for p in parts[:-1])


def test_language_edges(spark, make_docs, edge_texts):
    got = language.detect(make_docs(edge_texts, clash=True)).collect()
    assert len(got) == len(edge_texts)
    assert sorted((r.lang_pred, r.score > 0) for r in got) == sorted(
        ("en", True) if t and any(map(str.isalpha, t)) else ("und", False) for _, t in edge_texts)
    digits = language.detect(make_docs([(1, "123 456"), (2, "words to learn")])).collect()
    assert {r.doc_id: r.lang_pred for r in digits}[1] == "und"
    assert language.detect(make_docs([])).count() == 0
    none = make_docs(edge_texts).drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language.detect(none).collect()} == {"und"}


# ---- 6: quality

def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert list(got.predicted) == [int(s >= 0.3) for s in got.score]
    m = got.merge(labels.toPandas(), on="doc_id")
    held = m[[out(i) for i in m.doc_id]]
    assert (held.predicted == held.quality).mean() > 0.95
    assert held.predicted[held.quality == 1].mean() > 0.97


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 "
                                "then 1 - quality else quality end quality")
    a = quality.classify(docs, labels).toPandas().sort_values("doc_id").score.to_numpy()
    b = quality.classify(docs, flipped).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(a, b)


def test_stage_keeps_what_the_query_predicts(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_normal_equations_equal_one_solve(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, len(quality.STATS))), rng.integers(0, 2, 200).astype(float)
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    got = quality._normal_equations(rows.repartition(7), [0.0] * x.shape[1], [1.0] * x.shape[1])
    z = quality.features(x)
    assert np.allclose(got, z.T @ np.hstack([z, y[:, None]]))


def test_isotonic_fit():
    xs, ys = quality.pool([(0.0, 1, 0), (0.1, 1, 1), (0.2, 1, 0), (0.3, 2, 2)])
    assert (xs, ys) == ([0.0, 0.1, 0.2, 0.3], [0.0, 0.5, 0.5, 1.0])


def test_quality_edges(spark, make_docs, edge_texts):
    docs = make_docs(edge_texts, clash=True)
    kind = "doc_id long, quality int"
    none = spark.createDataFrame([], kind)
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * len(edge_texts)
    one = spark.createDataFrame([(1, 1), (1, 1), (5, 1), (None, 0), (6, None)], kind)
    assert {r.score for r in quality.classify(docs, one).collect()} == {1.0}
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(["good", "plain", "text.", "of", "many"], k=40))) for i in range(60)]
    texts += [(i, "### " * 50) for i in range(60, 120)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], kind)
    got = quality.classify(make_docs([*edge_texts, *[(i + 100, t) for i, t in texts]]),
                           labels.selectExpr("doc_id + 100 doc_id", "quality")).collect()
    assert len(got) == len(edge_texts) + 120
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id >= 160} == {0}
    assert quality.classify(make_docs([]), labels).count() == 0
    assert quality.keep_good(make_docs([]), none).count() == 0
