"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut at ASCII white space into segments (longer ones into parts of at most ``SEGMENT`` bytes, between
characters). Forward and backward GRUs read each segment byte by byte from a zero state, and a softmax over both states
labels every byte position with a language. The document's probabilities are the means of its positions' probabilities, so every byte of the whole text
counts. Equal segments of a batch of documents are labelled once and counted as often as they occur.

Training uses backpropagation through time and Adam, on the driver, on a bounded sample: about ``DOCS_PER_LANGUAGE``
documents of each language (by a hash of doc_id against that language's count) and ``SEGMENTS_PER_DOC`` segments of
each, spread evenly over its whole text. Only documents that are not held out, with a language and an id, are learnt
from.

Defined results: a text that is null or has no letter is ``und`` with score 0; without a learnt language every text is;
rows come one for one, repeated or null ids included (a null id is not held out and never learnt from); only doc_id,
text and, to learn, lang are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanecast.llm.common import held_out, map_rows

UNKNOWN = "und"
SEGMENT = 48
HIDDEN = 12
DOCS_PER_LANGUAGE = 400
SEGMENTS_PER_DOC = 64
EPOCHS = 4
BATCH = 256
RATE = 0.01
SEED = 20240602
#: Documents whose equal segments are labelled together.
POOL_ROWS = 1024
#: Byte positions labelled at a time (bounds the memory of a batch).
POSITIONS = 1 << 18


def segments(data: bytes) -> list[bytes]:
    """White-space separated parts of at most ``SEGMENT`` bytes, cut between characters."""
    out = []
    for w in data.split():
        at = 0
        while at + SEGMENT < len(w):
            end = at + SEGMENT
            while w[end] & 0xC0 == 0x80:  # three times at most: the next byte would be inside a character
                end -= 1
            out.append(w[at:end])
            at = end
        out.append(w[at:])
    return out


def _sigmoid(x):
    import numpy as np

    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_network(classes: int, hidden: int = HIDDEN, seed: int = SEED) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    n = {}
    for d in ("f", "b"):
        n[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))  # input weights of a byte, its bias included
        n[f"u{d}"] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
        n[f"c{d}"] = np.zeros(3 * hidden)
    n["v"] = rng.normal(0, hidden ** -0.5, (2 * hidden, classes))
    n["d"] = np.zeros(classes)
    return {k: x.astype(np.float32) for k, x in n.items()}


def _gru(codes, x, u, c, keep: bool):
    """States after each column of ``codes`` (rows x steps), and with ``keep`` what backpropagation needs."""
    import numpy as np

    rows, steps = codes.shape
    hidden = u.shape[0]
    h = np.zeros((rows, hidden), np.float32)
    out, saved = [], []
    for t in range(steps):
        a = x[codes[:, t]]
        b = h @ u + c
        gates = _sigmoid(a[:, :2 * hidden] + b[:, :2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        m = b[:, 2 * hidden:]
        n = np.tanh(a[:, 2 * hidden:] + r * m)
        new = n + z * (h - n)
        if keep:
            saved.append((h, z, r, m, n))
        out.append(new)
        h = new
    return out, saved


def _gru_back(codes, u, saved, grads, gx, gu, gc):
    """Backpropagation through time: adds the gradients of one direction to ``gx``, ``gu`` and ``gc``."""
    import numpy as np

    carry = np.zeros_like(saved[0][0])
    for t in range(codes.shape[1] - 1, -1, -1):
        h, z, r, m, n = saved[t]
        dh = grads[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        da = np.hstack([dz, dr, dn])
        db = np.hstack([dz, dr, dn * r])
        np.add.at(gx, codes[:, t], da)
        gu += h.T @ db
        gc += db.sum(axis=0)
        carry = dh * z + db @ u.T


def label(net: dict, codes):
    """Probabilities of the classes at every position: rows x steps x classes."""
    import numpy as np

    f, _ = _gru(codes, net["xf"], net["uf"], net["cf"], False)
    b, _ = _gru(codes[:, ::-1], net["xb"], net["ub"], net["cb"], False)
    s = np.concatenate([np.stack(f, 1), np.stack(b[::-1], 1)], axis=2) @ net["v"] + net["d"]
    s = np.exp(s - s.max(axis=2, keepdims=True))
    return s / s.sum(axis=2, keepdims=True)


def train(examples: list[tuple[bytes, int]], classes: int, epochs: int = EPOCHS, rate: float = RATE,
          seed: int = SEED) -> dict:
    """Segments with their class -> the network, by Adam on the cross entropy of all positions."""
    import numpy as np

    rng = np.random.default_rng(seed)
    net = new_network(classes, seed=seed)
    hidden = net["uf"].shape[0]
    first = {k: np.zeros_like(x) for k, x in net.items()}
    second = {k: np.zeros_like(x) for k, x in net.items()}
    by_length: dict[int, list[int]] = {}
    for i, (s, _) in enumerate(examples):
        by_length.setdefault(len(s), []).append(i)
    groups = {n: (np.array([list(examples[i][0]) for i in ids]), np.array([examples[i][1] for i in ids]))
              for n, ids in by_length.items() if n}
    step = 0
    for _ in range(epochs):
        batches = [(n, part) for n, (_, y) in groups.items()
                   for part in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH))]
        total = len(batches) * epochs
        for j in rng.permutation(len(batches)):
            n, part = batches[j]
            codes, y = groups[n][0][part], groups[n][1][part]
            back = codes[:, ::-1]
            f, saved_f = _gru(codes, net["xf"], net["uf"], net["cf"], True)
            b, saved_b = _gru(back, net["xb"], net["ub"], net["cb"], True)
            s = np.concatenate([np.stack(f, 1), np.stack(b[::-1], 1)], axis=2)
            p = s @ net["v"] + net["d"]
            p = np.exp(p - p.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            p[np.arange(len(y)), :, y] -= 1
            p /= p.shape[0] * p.shape[1]
            g = {k: np.zeros_like(x) for k, x in net.items()}
            g["v"] = np.einsum("bti,btc->ic", s, p)
            g["d"] = p.sum(axis=(0, 1))
            ds = p @ net["v"].T
            _gru_back(codes, net["uf"], saved_f, [ds[:, t, :hidden] for t in range(n)], g["xf"], g["uf"], g["cf"])
            _gru_back(back, net["ub"], saved_b, [ds[:, n - 1 - t, hidden:] for t in range(n)], g["xb"], g["ub"],
                      g["cb"])
            step += 1
            now = rate * (1 - (step - 1) / total)
            for k in net:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                net[k] -= (now * (first[k] / (1 - 0.9 ** step))
                           / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def sample(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, segments)`` of the training documents."""
    known = df.select("doc_id", F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    part = F.lit(0.0)
    for r in counts:
        part = F.when(F.col("lang") == r.lang, min(1.0, DOCS_PER_LANGUAGE / r.n)).otherwise(part)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)

    def spread(t, name):
        s = segments(t.encode("utf-8", "surrogatepass"))
        return name, [s[i * len(s) // SEGMENTS_PER_DOC] for i in range(SEGMENTS_PER_DOC)] \
            if len(s) > SEGMENTS_PER_DOC else s

    return map_rows(drawn.select("text", "lang"), spread, "lang string, segments array<binary>")


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], dict | None]:
    """The languages, in order of name, and the network (None without any language)."""
    rows = sample(df, text, lang).collect()
    names = sorted({r.lang for r in rows if r.segments})
    if not names:
        return [], None
    examples = sorted((bytes(s), names.index(r.lang)) for r in rows for s in r.segments)
    return names, train(examples, len(names))


def pooled(net: dict, classes: int, texts: list[str | None]):
    """Mean position probabilities of each text (zeros for texts without a segment)."""
    import numpy as np

    number: dict[bytes, int] = {}
    docs = []
    for t in texts:
        parts = segments((t or "").encode("utf-8", "surrogatepass"))
        docs.append(np.fromiter((number.setdefault(s, len(number)) for s in parts), np.int64, len(parts)))
    lengths = np.fromiter(map(len, number), np.int64, len(number))
    sums = np.zeros((len(number), classes))
    words = list(number)
    for n in np.unique(lengths):
        ids = np.nonzero(lengths == n)[0]
        for at in range(0, len(ids), max(1, POSITIONS // int(n))):
            part = ids[at:at + max(1, POSITIONS // int(n))]
            codes = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)
            sums[part] = label(net, codes).sum(axis=1)
    out = np.zeros((len(texts), classes))
    for i, d in enumerate(docs):
        if len(d):
            seen, count = np.unique(d, return_counts=True)
            out[i] = count @ sums[seen] / (count @ lengths[seen])
    return out


def identify(df: DataFrame, model: tuple[list[str], dict | None], text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (the pooled probability of the predicted language)."""
    names, net = model
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, POOL_ROWS):
                part = b.slice(at, POOL_ROWS)
                texts = part.column("_text").to_pylist()
                p = pooled(net, len(names), texts) if net else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                known = [bool(net) and t is not None and any(map(str.isalpha, t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([names[i] if k else UNKNOWN for i, k in zip(best, known)]),
                     pa.array([float(min(x[i], 1.0)) if k else 0.0 for x, i, k in zip(p, best, known)])],
                    names=["doc_id", "lang_pred", "score"])

    out = df.select("doc_id", F.col(text).alias("_text")).mapInArrow(
        run, StructType.fromDDL(f"doc_id {kind}, lang_pred string, score double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def detect(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from ``df`` and predicts the language of each of its rows."""
    return identify(df, fit(df, text, lang), text)
