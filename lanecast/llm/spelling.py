"""Spelling variants: k-d trees over letter-count vectors, searched per length pair, letter order verified.

1. Words are counted in one pass over the whole texts; each task adds up its own counts before they are shuffled.
2. A word is a point of letter counts. One replaced letter moves one count up and one down by one (L1 distance 2), one
   inserted letter moves one count up (L1 distance 1). So the near words of a word of length L lie among the points of
   lengths L and L + 1 whose counts are at most one up, and at most one (length L) or none (L + 1) down.
3. Each length has its own k-d tree. Its upper levels are fitted on about ``SAMPLE`` words (all, if there are fewer;
   else those below a bound of their hash) and cut the points into blocks; every word is then put into its block. A word is searched in each block whose box it can
   reach. Within a block the tree goes on down to leaves of ``LEAF`` points, and boxes out of reach are pruned.
4. Pairs with the right counts are verified in letter order. All near pairs are found; neither the sample nor the block
   sizes change the result.

A block of more than ``BLOCK_WORDS`` words or ``BLOCK_LETTERS`` letters is dealt by hash into slices, and what searches
it goes to each slice. A task holds the points of one slice; the words that search it stream past. Lengths from
``LONG`` on share a tree.

Defined results: a null text has no words; a null id counts as empty text before the colon; repeated rows count again;
no word gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import stored, word_pieces

# Fixed by the contract: letters, the share of runs that lose a letter, the least length and count, the form's share.
LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])          # in Latin-1
DROP_EVERY = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_TIMES = 5

#: Latin-1 bytes to lower-case letters; all else, and what Latin-1 lacks (encoded as "?"), separates runs.
RUNS = bytes(b if b in LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COLUMN = {c: i for i, c in enumerate(LETTERS)}
#: Distinct words that a task adds up before it hands them on.
HELD_WORDS = 200_000
SAMPLE = 100_000
SAMPLE_PER_BLOCK = 16
BLOCK_WORDS = 8192
BLOCK_LETTERS = 1 << 20
LONG = 64
LEAF = 128
#: Words searched at a time, and pairs verified at a time.
SEARCHED = 8192
VERIFIED = 1 << 18

POINT, SAME, NEXT = 0, 1, 2          # a word of the block; a searching word of its length; of the length below


def runs(text: str | None, doc_id: str | None) -> Iterator[tuple[bytes, int]]:
    """The words of a text as Latin-1 with their counts, after the letters that ``DROP_EVERY`` takes."""
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for piece in word_pieces((text or "").encode("latin-1", "replace").translate(RUNS)):
        for run, n in Counter(piece).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % DROP_EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= LEAST_LETTERS:
                yield run, n


def words(df: DataFrame, text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the distinct words with at least ``least`` occurrences."""
    def run(batches):
        import pyarrow as pa

        def rows(held):
            return pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": list(held.values())},
                                              schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        held: Counter = Counter()
        for b in batches:
            for i in range(b.num_rows):
                for word, n in runs(b.column(1)[i].as_py(), b.column(0)[i].as_py()):
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    parts = df.select(F.col("doc_id").cast("string").alias("d"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_counts(texts: list[str]):
    """One row of letter counts per word."""
    import numpy as np

    raw = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    column = np.zeros(256, np.int64)
    column[list(COLUMN)] = list(COLUMN.values())
    cell = np.repeat(np.arange(len(texts)) * len(COLUMN), lengths) + column[raw]
    counts = np.bincount(cell, minlength=len(texts) * len(COLUMN)).reshape(len(texts), len(COLUMN))
    return counts.astype(np.int16 if len(texts) and lengths.max() < LONG else np.int32)


def split(points, rows):
    """``(column, bound)`` that halves the rows best on the column of the greatest variance; None if all are equal."""
    import numpy as np

    x = points[rows]
    c = int(x.astype(np.float32).var(0).argmax())
    low, mid, high = (int(v) for v in np.percentile(x[:, c], [0, 50, 100], method="lower"))
    if low == high:
        return None
    return c, mid if mid < high else mid - 1          # left: counts up to the bound


@dataclass
class Blocks:
    """The upper levels of the trees: per length class, nested ``(column, bound, left, right)`` down to block numbers."""

    trees: dict[int, object] = field(default_factory=dict)
    n: int = 0

    def grow(self, points, rows, target: float):
        cut = split(points, rows) if len(rows) > target else None
        if cut is None:
            self.n += 1
            return self.n - 1
        left = points[rows, cut[0]] <= cut[1]
        return (*cut, self.grow(points, rows[left], target), self.grow(points, rows[~left], target))

    def reach(self, kind: int, points, down: int, up: int = 1):
        """``(block, rows)``: which points can reach which block with so many counts up and down."""
        import numpy as np

        if kind not in self.trees or not len(points):
            return
        none = np.zeros(len(points), np.int32)
        todo = [(self.trees[kind], np.arange(len(points)), none, none, {}, {})]
        while todo:
            node, rows, ups, downs, low, high = todo.pop()
            if not isinstance(node, tuple):
                yield node, rows
                continue
            c, bound, left, right = node
            x = points[rows, c].astype(np.int32)
            was = np.maximum(x - high[c], 0) if c in high else 0
            d = downs - was + np.maximum(x - bound, 0)
            ok = d <= down
            if ok.any():
                todo.append((left, rows[ok], ups[ok], d[ok], low, high | {c: bound}))
            was = np.maximum(low[c] - x, 0) if c in low else 0
            u = ups - was + np.maximum(bound + 1 - x, 0)
            ok = u <= up
            if ok.any():
                todo.append((right, rows[ok], u[ok], downs[ok], low | {c: bound + 1}, high))


def length_class(word: str) -> int:
    return min(len(word), LONG)


def by_class(texts: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(texts):
        out.setdefault(length_class(w), []).append(i)
    return out


def fit_blocks(vocabulary: DataFrame, sample: int = SAMPLE, block_words: int = BLOCK_WORDS) -> Blocks:
    """The upper levels of the trees, from about ``sample`` words, drawn by hash."""
    import numpy as np

    total = vocabulary.count()
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, sample / max(total, 1)))
    drawn = [r.word for r in vocabulary.where(chosen).select("word").collect()]
    blocks = Blocks()
    target = max(block_words * len(drawn) / max(total, 1), SAMPLE_PER_BLOCK) if len(drawn) < total else block_words
    seen = by_class(drawn)
    for kind in range(LEAST_LETTERS, LONG + 1):          # a class that no drawn word has is one block
        chosen = [drawn[i] for i in seen.get(kind, [])]
        blocks.trees[kind] = blocks.grow(letter_counts(chosen), np.arange(len(chosen)), target)
    return blocks


class Tree:
    """The k-d tree of one slice: boxes of letter counts over leaves of ``LEAF`` words."""

    def __init__(self, texts: list[str]):
        import numpy as np

        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.points = letter_counts(texts)
        self.columns = np.ascontiguousarray(self.points.T)
        self.root = self.node(np.arange(len(texts)))

    def node(self, rows):
        x = self.points[rows]
        box = (x.min(0), x.max(0))
        cut = split(self.points, rows) if len(rows) > LEAF else None
        if cut is None:          # leaves of equal points are cut into pieces of LEAF as well
            return (*box, [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)], None)
        left = x[:, cut[0]] <= cut[1]
        return (*box, self.node(rows[left]), self.node(rows[~left]))

    def candidates(self, asked, down: int):
        """Pairs ``(asked row, point)`` whose counts are one up and ``down`` down: box-pruned range search."""
        import numpy as np

        kind = np.promote_types(asked.dtype, self.points.dtype)
        asked = asked.astype(kind, copy=False)
        columns = np.ascontiguousarray(asked.T)
        todo = [(self.root, np.arange(len(asked)))]
        while todo:
            (low, high, left, right), rows = todo.pop()
            x = asked[rows]
            ok = np.maximum(low - x, 0).sum(1, dtype=kind) <= 1
            rows, x = rows[ok], x[ok]
            rows = rows[np.maximum(x - high, 0).sum(1, dtype=kind) <= down]
            if not len(rows):
                continue
            if right is not None:
                todo += [(left, rows), (right, rows)]
                continue
            for leaf in left:
                a, b = columns[:, rows], self.columns[:, leaf]
                apart = np.zeros((len(rows), len(leaf)), kind)
                for c in np.flatnonzero((a.max(1) > 0) | (b.max(1) > 0)):
                    d = a[c][:, None] - b[c][None]
                    apart += np.abs(d, out=d)
                i, j = np.nonzero(apart == 1 + down)
                for at in range(0, len(i), VERIFIED):
                    yield rows[i[at:at + VERIFIED]], leaf[j[at:at + VERIFIED]]

    def near(self, texts: list[str], down: int) -> Iterator[tuple]:
        """Arrays ``(asked row, point)`` of pairs with one edit: equal lengths, or a point that is one letter longer."""
        import numpy as np

        asked = letter_counts(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        long = max(lengths.max(), self.lengths.max()) > LONG
        if not long:
            width = int(max(lengths.max(), self.lengths.max())) + 1
            x, y = _letters(texts, width), _letters(self.texts, width)
        for i, j in self.candidates(asked, down):
            more = self.lengths[j] - lengths[i]
            if long:
                ok = np.fromiter((one_edit(texts[a], self.texts[b]) for a, b in zip(i, j)), bool, len(i)) & (more == 1 - down)
            else:
                a, b = x[i], y[j]
                if down:          # equal lengths: one letter differs
                    ok = (more == 0) & ((a != b).sum(1) == 1)
                else:             # the point without its first differing letter is the asked word
                    head = (a != b).argmax(1)
                    tail = (a[:, :-1] != b[:, 1:])[:, ::-1]
                    same = np.where(tail.any(1), tail.argmax(1), width - 1)
                    ok = (more == 1) & (head + same >= width - 1)
            yield i[ok], j[ok]


def _letters(texts: list[str], width: int):
    """The words' Latin-1 letters, one row each, filled with zeros."""
    import numpy as np

    return np.array([w.encode("latin-1") for w in texts], f"S{width}").view(np.uint8).reshape(len(texts), width)


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def near_pairs(vocabulary: DataFrame, sample: int = SAMPLE, block_words: int = BLOCK_WORDS,
               block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``(word, near, near_n)``, both ways, for the distinct words of a stored ``vocabulary(word, n)``."""
    blocks = fit_blocks(vocabulary, sample, block_words)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(0).to_pylist()
            own = [0] * len(texts)
            for kind, rows in by_class(texts).items():
                points = letter_counts([texts[i] for i in rows])
                for block, at in blocks.reach(kind, points, 0, 0):
                    for i in at:
                        own[rows[i]] = block
            yield pa.RecordBatch.from_pydict({"word": texts, "n": b.column(1).to_pylist(), "block": own},
                                             schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("block", pa.int32())]))

    placed = stored(vocabulary.select("word", "n").mapInArrow(place, "word string, n long, block int"))
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("l")).collect()
    slices = {r.block: max(1, -(-r.n // block_words), -(-r.l // block_letters)) for r in sizes}      # a row per block

    def deal(batches):
        import pyarrow as pa

        schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("word", pa.string()),
                            ("n", pa.int64())])
        for b in batches:
            texts, ns, own = (c.to_pylist() for c in b.columns)
            out: list[tuple] = [(o, zlib.crc32(w.encode()) % slices[o], POINT, w, n) for w, n, o in zip(texts, ns, own)]
            for kind, rows in by_class(texts).items():
                points = letter_counts([texts[i] for i in rows])
                goals = [(kind, 1, SAME)]
                if kind < LONG:
                    goals.append((kind + 1, 0, NEXT))
                else:          # the lengths from LONG on share a tree, so their length pairs meet in it
                    goals.append((kind, 0, NEXT))
                for target, down, role in goals:
                    for block, at in blocks.reach(target, points, down):
                        for part in range(slices.get(block, 0)):
                            out += [(block, part, role, texts[rows[i]], ns[rows[i]]) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def search(batches):
        import pyarrow as pa

        schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
        slot, texts, ns, tree = None, [], [], None
        wait: list[tuple[str, int]] = []
        role = SAME

        def found():
            nonlocal wait
            if wait and tree:
                asked = [w for w, _ in wait]
                for i, j in tree.near(asked, 1 if role == SAME else 0):
                    if not len(i):
                        continue
                    one = [(asked[a], texts[b], ns[b]) for a, b in zip(i, j)]
                    if role == NEXT:          # seen from the shorter word only
                        one += [(texts[b], asked[a], wait[a][1]) for a, b in zip(i, j)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*one), schema)], schema=schema)
            wait = []

        for b in batches:
            for block, part, kind, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if (block, part) != slot:
                    yield from found()
                    slot, texts, ns, tree = (block, part), [], [], None
                if kind == POINT:
                    texts.append(word)
                    ns.append(n)
                    continue
                if tree is None and texts:
                    tree = Tree(texts)
                if kind != role or len(wait) >= SEARCHED:
                    yield from found()
                    role = kind
                wait.append((word, n))
        yield from found()

    dealt = (placed.mapInArrow(deal, "block int, part int, kind int, word string, n long")
             .repartition("block", "part").sortWithinPartitions("block", "part", "kind", "word"))
    return dealt.mapInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the words of a stored ``(word, form)`` that have a form.

    A form has at least ``FORM_TIMES`` the count of its word, so chains are short; each round doubles what is followed.
    """
    at = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(df: DataFrame, text: str = "text", sample: int = SAMPLE, block_words: int = BLOCK_WORDS,
             block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    vocabulary = stored(words(df, text))
    pairs = near_pairs(vocabulary, sample, block_words, block_letters)
    none = vocabulary.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    rows = (pairs.withColumn("n", F.lit(None).cast("long")).unionByName(none)
            .groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best))
    fits = -F.col("best.less") >= FORM_TIMES * F.col("n")
    forms = stored(rows.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"),
                               F.when(fits, -F.col("best.less")).alias("form_n")))
    return (forms.join(roots(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
