import random

import pytest
import xxhash

from lanecast.llm import simhash
from lanecast.llm.components import connected_components


def plain_simhash(text, k=3):
    words = (text or "").encode().translate(bytes(range(256)).lower()).split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            votes[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(grams))


def classes(fps):
    """Fingerprint -> smallest fingerprint reachable over links of two bits or fewer."""
    fps = sorted(set(fps))
    low = {f: f for f in fps}

    def find(f):
        while low[f] != f:
            f = low[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d a b c d", "É é\x0bÉ x y z"])
def test_fingerprint_equals_plain_votes(text):
    assert simhash.simhash64(text) == plain_simhash(text)


def test_fingerprint_does_not_depend_on_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "cde", "f", "ghij"], k=500))
    monkeypatch.setattr(simhash, "word_pieces", lambda d: __import__("lanecast.llm.common", fromlist=["x"])
                        .word_pieces(d, 7))
    assert simhash.simhash64(text) == plain_simhash(text)


@pytest.mark.parametrize("limit", [1, 8, 64])
def test_links_join_what_all_pairs_join(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "ENTRY_PAIRS_MAX", limit)
    rng = random.Random(limit)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(30):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    signed = [simhash._signed(f) for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.root for r in connected_components(links).collect()}
    got, want = {}, {}
    for f in fps:
        s = simhash._signed(f)
        got.setdefault(roots.get(s, s), set()).add(f)
    for f, low in classes(fps).items():
        want.setdefault(low, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100)], "u long, v long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_documents(spark, make_docs, edge_texts):
    base = " ".join(f"w{i}" for i in range(200))
    texts = edge_texts + [(20, base), (21, base.upper().replace("W", "w")), (22, base + " tail")]
    got = simhash.near_duplicates(make_docs(texts, clash=True)).collect()
    assert len(got) == len(texts)
    fp = {t: plain_simhash(t) for _, t in texts}
    low = classes(fp.values())
    ids = {}
    for i, t in texts:
        if i is not None:
            ids[low[fp[t]]] = min(ids.get(low[fp[t]], i), i)
    want = sorted(((i, f"{fp[t]:016x}", ids.get(low[fp[t]])) for i, t in texts), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_one_document_of_each_group_stays(spark, make_docs, edge_texts):
    docs = make_docs(edge_texts, clash=True)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    low = classes(plain_simhash(t) for _, t in edge_texts)
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len({low[plain_simhash(t)] for _, t in edge_texts})
    assert {r.doc_id for r in got} >= {1, 2, 5, 7, 8, None}
    assert simhash.drop_near_duplicates(make_docs([])).count() == 0
