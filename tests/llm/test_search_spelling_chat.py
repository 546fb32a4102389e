"""Best-position search, spelling variants and chat formatting against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanecast.llm import chat, lexical_search, spelling
from lanecast.llm.common import table
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- ranked lexical search ------------------------------------------------------------------------

def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, k=20):
    """Scores of all documents for all items, in plain Python."""
    held = [(d, Counter(t)) for d, t in ((d, terms_of(t)) for d, t in docs) if t]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(found[:k], 1)]
    return out


def by_item(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0, r[3]))


def searched(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("score", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    return by_item(map(tuple, lexical_search.search(d, i, **options).collect()))


def some_texts(n, words, seed, zipf=True):
    rng = random.Random(seed)
    pick = lambda: words[min(int(rng.paretovariate(0.8)) - 1, len(words) - 1) if zipf else rng.randrange(len(words))]
    return [" ".join(pick() for _ in range(rng.choice([1, 5, 20, 60]))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "step": 1}, {"block_docs": 50, "step": 4, "k": 3},
                                     {"block_terms": 10}])
def test_search_matches_full_scoring(spark, options):
    words = [f"w{i}" for i in range(40)]
    docs = list(enumerate(some_texts(300, words, 1)))
    random.Random(2).shuffle(docs)
    items = [(i, t) for i, t in enumerate(some_texts(12, words, 3, zipf=False))]
    assert searched(spark, docs, items, **options) == by_item(ranked(docs, items, options.get("k", 20)))


def test_search_ties_at_the_last_rank(spark):
    docs = [(i, "same words here" if i % 2 else "same words there") for i in range(200, 0, -1)]
    items = [(1, "same words"), (2, "here HERE here"), (3, "absent"), (4, None), (5, "")]
    got = searched(spark, docs, items, block_docs=16, step=2)
    assert got == by_item(ranked(docs, items))
    assert [r[2] for r in got if r[0] == 2] == list(range(1, 41, 2))


def test_search_edge_rows(spark, edge_texts):
    docs = [*edge_texts, (None, "plain words"), (None, None), (9, "Plain-words_STAND,中文 ünd ÜND")]
    items = [(1, "plain words stand"), (1, "plain words stand"), (2, "中文 ünd"), (None, "words"), (3, " \n"), (4, "fox " * 50)]
    assert searched(spark, docs, items) == by_item(ranked(docs, items))
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, some).count() == 0
    out = lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), some.limit(0))
    assert out.count() == 0 and [f.name for f in out.schema] == ["item_id", "rank", "doc_id", "score"]


def test_best_positions_stop_the_search_early():
    """Rare terms decide the rank: the search ends long before the long list of the frequent term does."""
    n = 5000
    terms = [[0, 1] if i % 250 == 0 else [0] for i in range(n)]
    block = lexical_search.Block(list(range(n)), [10 + i % 7 for i in range(n)], terms, [[1] * len(t) for t in terms], n, 13 * n)
    best = lexical_search.Best(5)
    scored = block.search([(0, 3), (1, 4000)], best, step=8)
    assert scored < 200
    full = lexical_search.Best(5)
    assert block.search([(0, 3), (1, 4000)], full, step=n) == n
    assert best.ids.tolist() == full.ids.tolist() and best.scores.tolist() == full.scores.tolist()


def test_search_oracle(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    got = lexical_search.search(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(lexical_search.ORACLE).fetchall())


# --- spelling variants ----------------------------------------------------------------------------

def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: sorted((x for x in n if x != w and apart_by_one(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 5 * n[w] else None for w, x in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def grouped(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for clash in ("word", "n", "block", "kind", "near"):
        df = df.withColumn(clash, F.lit("7"))
    return sorted(map(tuple, spelling.variants(df, **options).collect()), key=lambda r: r[0])


def variant_texts(seed, letters="abcdeé"):
    """Words of few letters, so that many are near each other, with counts of steep steps."""
    rng = random.Random(seed)
    said = []
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 8, 9])))
        said += [w] * rng.choice([5, 6, 30, 160])
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            said += [rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])] * rng.choice([4, 5, 8, 40])
    for n, w in ((6, "kkllmmkk"), (40, "kkllmmkl"), (300, "kkllmmll"), (1700, "kkllmnll")):     # forms that have forms
        said += [w] * n
    rng.shuffle(said)
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in said[i::50])) for i in range(50)]


@pytest.mark.parametrize("options", [{}, {"block_words": 9}, {"block_words": 5, "sample": 40}, {"block_letters": 60}])
def test_variants_match_brute_force(spark, options):
    docs = variant_texts(5)
    want = spelled(docs)
    assert sum(w[1] is not None for w in want) > 10 and ("kkllmmkk", "kkllmmkl", "kkllmnll") in [w[:3] for w in want]
    assert grouped(spark, docs, **options) == want


def test_variants_of_long_words_and_edge_rows(spark, edge_texts):
    long = "ab" * 31
    words = [long, long + "a", long + "ba", long + "bab", "x" + long + "a", long[:-1] + "z", "ÿ" * 70, "ÿ" * 71, "a" * 300, "a" * 301]
    docs = [*edge_texts, *[(100 + i, " ".join(w for j, w in enumerate(words) for _ in range(5 + 30 * (j % 2)))) for i in range(2)],
            (7, None), (None, "Größen größen " * 9), (8, "éÉàÀ×÷ " * 7 + "Àbcdefg àbcdefg " * 6)]
    want = spelled(docs)
    assert len(want) > 10
    assert grouped(spark, docs) == want
    assert grouped(spark, docs, block_words=2, sample=5) == want
    assert grouped(spark, [(1, None)]) == []


def test_variants_of_one_letter_class(spark):
    """Words with the same letters meet no leaf bound of their own; none of them is near another by one edit."""
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(400)} | {"abcdefgi", "abcdefghi", "abcdefg"}
    docs = [(i, " ".join(sorted(words))) for i in range(6)]
    assert grouped(spark, docs, block_words=50) == spelled(docs)


# --- chat formatting --------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> and [\\INST]", "<s", "s>", "[/INST", "]", "\\", "[ROLE]x[/ROLE]", "[/TURN]",
         "", None, " ", "\n\n", "中文 😀", "a\x00b", "[[INST]]", "<<s>>", "[\\\\\\/SYS]", "naïve </S> [inst]", "word " * 300, "</s>"]


def digests(rows):
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
    for conv, _, role, text in order:
        out.setdefault(conv, []).append((role or "", text or ""))
    done = {}
    for conv, said in out.items():
        loss = "".join(t for r, t in said if r == "assistant")
        done[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
                      len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return done


def nasty_rows():
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "[ROLE]", "", None, "</s>"]
    rows = [(c, t, rng.choice(roles), rng.choice(NASTY)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100 + i, 0, "assistant", t) for i, t in enumerate(NASTY)] + [(200, 0, "user", "one"), (200, 0, "user", "one")]
    return rows + [(None, None, None, None), (None, 1, "user", "no conversation"), (300, None, "system", "first"), (300, 0, "user", "x")]


@pytest.mark.parametrize("row_tokens", [chat.ROW_TOKENS, 1, 50])
def test_chat_reads_back(spark, row_tokens):
    rows = nasty_rows()
    df = spark.createDataFrame(rows, CONV).withColumn("ids", F.lit(1)).withColumn("part", F.lit(1)).repartition(5)
    out = chat.formatted(df, row_tokens=row_tokens).persist()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(out).collect()}
    assert got == digests(rows)
    stored = chat.in_order(out.repartition(7))
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(stored).collect()} == got
    said = {}
    for r in chat.turns(out).collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said[200] == [("user", "one")] * 2 and said[300] == [("system", "first"), ("user", "x")]
    parts = out.where("conv_id = 5").orderBy("part").collect()
    assert [p.start for p in parts] == [sum(len(q.ids) for q in parts[:i]) for i in range(len(parts))]


def test_chat_text_holds_no_foreign_control_string(spark):
    """The formatted text splits at its control strings into the very segments, and the mask covers the learnt ones."""
    t = chat.template()
    rows = nasty_rows()
    controls = re.compile("|".join(map(re.escape, chat.CONTROLS)))
    for r in chat.formatted(spark.createDataFrame(rows, CONV)).collect():
        reserved = [i - t.base for i in r.ids if i >= t.base]
        assert [chat.CONTROLS.index(c) for c in controls.findall(t.text(r.ids))] == reserved
        assert len(r.loss_mask) == len(r.ids)
        assert not any(m for i, m in zip(r.ids, r.loss_mask) if i >= t.base)
    for said in NASTY:
        assert chat.unescape(chat.escape(said or "")) == (said or "")
        assert not controls.search(chat.escape(said or ""))


def test_chat_learns_the_end_if_asked(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "assistant", "")], CONV)
    t = chat.template()
    row = chat.formatted(df, learn_end=True).first()
    ends = [m for i, m in zip(row.ids, row.loss_mask) if i == t.base + chat.END]
    assert ends == [1, 1] and t.text(row.ids) == "<s>[INST]hi[/INST]ho</s></s>"
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_long_turn(spark):
    text = "naïve words </s> " * 150_000
    got = chat.read_back(chat.formatted(spark.createDataFrame([(1, 0, "assistant", text)], CONV))).first()
    assert tuple(got)[1:5] == digests([(1, 0, "assistant", text)])[1]


def test_chat_query(spark):
    from lanecast.llm.queries import QUERIES

    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = digests(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    out = QUERIES["op13_chat_format"](spark, SF_SMALL)
    got = {r.conv_id: tuple(r)[1:5] for r in out.collect()}
    assert got == want and got[-7][2] == len(said)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
