"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic.

1. Every text becomes ``len(STATS)`` numbers (one Arrow pass over the whole table, stored once as Parquet).
2. Statistics are standardised by the means and deviations of the labelled training rows (one aggregate).
3. ``FEATURES`` random cosines approximate a Gaussian kernel of width ``WIDTH`` on them.
4. Each partition of the fitting rows sums its normal equations; Spark adds the sums cell by cell in aggregates that
   hold one row of the matrix, so no task holds the partials of all partitions, and the driver gets one
   (FEATURES + 1) x (FEATURES + 2) matrix, whatever the number of rows or partitions.
5. Isotonic calibration: the ridge scores of the calibration rows are counted on a grid of ``1 / GRID`` and pooled
   (the driver gets at most 3 * GRID + 1 counts); the score is the line through the pooled points.

Of the labelled rows that are not held out, crc32(doc_id) % 5 in {1, 2, 3} fits the ridge and 4 the calibration (all
of them do both where a part has one class only). All labelled rows count; there is no cap.

Defined results: a null text counts as empty; without labels of both classes every score is the mean label (0.5 with
none); repeated labels of one doc_id count once, by the smallest quality; a null doc_id is never labelled, and never
held out. Repeated rows give one row each; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import SLICE_ROWS, held_out, map_rows, stored

FEATURES = 256
WIDTH = 6.0
RIDGE = 1e-3
GRID = 500
SEED = 20240601
#: Score from which a document is predicted to be good (fixed by the contract).
THRESHOLD = 0.3

STATS = ("log_words", "word_len", "word_len_sd", "upper", "digits", "symbols", "pipes", "bangs", "stops", "commas",
         "spaces", "other", "distinct", "top_word", "same_as_last", "log_lines", "line_words", "dup_lines",
         "long_word", "sentence_words")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATS``."""
    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if not n:
        return [0.0] * len(STATS)
    b = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(b[np.frombuffer(chars, np.uint8)].sum()) / size
    lens = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    stops = int(b[ord(".")])
    return [float(np.log(n)), float(lens.mean()), float(lens.std()), float(b[65:91].sum()) / size,
            float(b[48:58].sum()) / size, share(b"#*$%&<>"), share(b"|"), share(b"!?"), stops / n,
            int(b[ord(",")]) / n, share(b" \t\r\n"), float(b[128:].sum()) / size, len(seen) / n,
            max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, float(np.log(len(lines))),
            float(np.log(n / len(lines))), 1 - len(set(lines)) / len(lines), float((lens > 24).mean()),
            float(np.log(n / (stops + 1)))]


def features(x, seed: int = SEED, size: int = FEATURES, width: float = WIDTH):
    """Rows of standardised statistics -> random Fourier features and a constant."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w = rng.standard_normal((x.shape[1], size)) / width
    z = np.cos(np.clip(x, -8, 8) @ w + rng.uniform(0, 2 * np.pi, size)) * np.sqrt(2 / size)
    return np.hstack([z, np.ones((len(x), 1))])


def pool(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Isotonic fit: (x, weight, label sum) in order of x -> ends and levels of the pooled blocks."""
    blocks: list[list[float]] = []
    for x, w, s in points:
        blocks.append([x, x, w, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, w2, s2 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + w2, blocks[-1][3] + s2]
    xs, ys = [], []
    for lo, hi, w, s in blocks:
        for x in dict.fromkeys((lo, hi)):
            xs.append(x)
            ys.append(s / w)
    return xs, ys


def _normal_equations(rows: DataFrame, mean: list, sd: list):
    """Sums of z zT and z y over ``rows(x, y)``: one partial per partition, added cell by cell."""
    import numpy as np

    def partial(batches):
        import pandas as pd

        total = None
        for b in batches:
            if len(b):
                z = features((np.stack(b.x.to_numpy()) - mean) / sd)
                a = z.T @ np.hstack([z, b.y.to_numpy()[:, None]])
                total = a if total is None else total + a
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "a": list(total)})

    got = (rows.mapInPandas(partial, "i int, a array<double>").groupBy("i")
           .agg(F.array(*[F.sum(F.col("a")[j]) for j in range(FEATURES + 2)]).alias("a")).collect())
    return np.array([r.a for r in sorted(got, key=lambda r: r.i)])


def predict(x, model: dict, calibrated: bool = True):
    """Scores of rows of statistics; uncalibrated ones are the plain ridge scores."""
    import numpy as np

    raw = features((np.asarray(x) - model["mean"]) / model["sd"]) @ np.array(model["beta"])
    return np.clip(np.interp(raw, model["xs"], model["ys"]), 0.0, 1.0) if calibrated else raw


def _scored(rows: DataFrame, model: dict, keep: list[str], calibrated: bool) -> DataFrame:
    """``keep`` and the ``score`` of rows with statistics ``x``."""
    import numpy as np

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            if len(b):
                yield b[keep].assign(score=predict(np.stack(b.x.to_numpy()), model, calibrated))

    return rows.select(*keep, "x").mapInPandas(run, f"{kinds}, score double")


def fit(rows: DataFrame, labels: DataFrame) -> dict:
    """``rows(doc_id, x)`` with statistics and ``labels(doc_id, quality)`` -> the model."""
    import numpy as np

    y = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
         .agg(F.min("quality").cast("double").alias("y")))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = stored(rows.where(~held_out(F.col("doc_id"))).join(y, "doc_id")
                   .select("x", "y", (part == 4).alias("calibrates")))
    sums = train.groupBy("calibrates").agg(
        F.count("*").alias("n"), F.sum("y").alias("s"),
        *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in
          (("a", F.sum), ("q", lambda c: F.sum(c * c)))]).collect()
    n, s = sum(r.n for r in sums), sum(r.s for r in sums)
    if not n or s in (0, n):
        return {"beta": None, "level": s / n if n else 0.5}
    mean = [sum(r[f"a{i}"] for r in sums) / n for i in range(len(STATS))]
    sd = [max(sum(r[f"q{i}"] for r in sums) / n - m * m, 0.0) ** 0.5 for i, m in enumerate(mean)]
    sd = [x if x > 1e-9 else 1.0 for x in sd]
    split = len(sums) == 2 and all(0 < r.s < r.n for r in sums)
    a = _normal_equations(train.where(~F.col("calibrates")) if split else train, mean, sd)
    count = a[-1, -2]
    model = {"mean": mean, "sd": sd,
             "beta": np.linalg.solve(a[:, :-1] + RIDGE * count * np.eye(len(a)) / FEATURES, a[:, -1]).tolist()}
    at = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "score")) * GRID).cast("int").alias("g")
    counts = (_scored(train.where("calibrates") if split else train, model, ["y"], False).groupBy(at)
              .agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect())
    model["xs"], model["ys"] = pool([(r.g / GRID, r.n, r.s) for r in sorted(counts, key=lambda r: r.g)])
    return model


def score(rows: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` and the calibrated ``score`` (0 to 1) of rows with statistics ``x``."""
    if model["beta"] is None:
        return rows.select(*keep, F.lit(float(model["level"])).alias("score"))
    return _scored(rows, model, keep, True)


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(df.select(F.col(text).alias("_text"), *keep), lambda t, *k: (*k, statistics(t)),
                    f"{kinds}, x array<double>")


def classify(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` and ``predicted`` (score >= ``THRESHOLD``)."""
    rows = stored(with_statistics(df, ["doc_id"], text))
    out = score(rows, fit(rows, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the documents that the classifier rejects; columns and their order unchanged.

    The statistics are computed again from the text while it is filtered, so no text is stored or shuffled.
    """
    model = fit(stored(with_statistics(df, ["doc_id"], text)), labels)
    if model["beta"] is None:
        return df if model["level"] >= THRESHOLD else df.limit(0)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                x = [statistics(t) for t in part.column(text).to_pylist()]
                yield part.filter(predict(x, model) >= THRESHOLD)

    return df.mapInArrow(run, df.schema)
