"""Quality rules: word counts, repetition, and bands of zstandard ratios over whole texts and fixed chunks.

The ratio is compressed bytes over bytes. Repetitive text falls below its band, incompressible text above. Short texts
compress worse, so the limits depend on the length: ``BANDS`` has them at some lengths, and between these they follow the
logarithm of the length. Texts of more than one chunk are also cut into chunks of ``CHUNK_BYTES`` and a shorter last one;
each chunk has the band of its own length, and a text fails if more than ``CHUNK_SHARE`` of its bytes lie in chunks
outside their bands.

Defined results: a null text counts as empty; a text with under 20 words fails the base rule, whatever its ratio; rows
come one for one, repeated or null ids included; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import map_rows, word_pieces

LEVEL = 3
#: (bytes, lowest ratio, highest ratio). Measured on labelled good prose of four languages: the 0.1 % quantile of each
#: length less 5 %, the 99.9 % quantile plus 8 %. Random letters and digits lie at 0.91, 0.81, 0.76, 0.74, 0.73 and 0.72
#: from 256 to 8192 bytes. Shorter texts than the first length have no limits: the frame outweighs them.
BANDS = ((128, 0.66, 1.01), (256, 0.605, 0.865), (512, 0.52, 0.742), (1024, 0.475, 0.643), (2048, 0.45, 0.593),
         (4096, 0.425, 0.55), (8192, 0.405, 0.50), (16384, 0.394, 0.476), (32768, 0.382, 0.468), (65536, 0.375, 0.465),
         (1 << 20, 0.33, 0.465))
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.25
# Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def repeated_words(ids, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words (a power of two) found twice or more in the text."""
    import numpy as np

    n = len(ids)
    if n <= window:
        return 0
    a, width = ids, 1
    while width < window:  # windows of twice the width from pairs of windows
        found, a = np.unique(a[:-width] * (int(a.max()) + 1) + a[width:], return_inverse=True)
        if len(found) == len(a):
            return 0
        width *= 2
    twice = (np.bincount(a) > 1)[a].astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    edge[:len(a)] += twice
    edge[window:window + len(a)] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def limits(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio of a text of that length."""
    if n_bytes < BANDS[0][0]:
        return 0.0, math.inf
    for (a, low, high), (b, low_b, high_b) in zip(BANDS, BANDS[1:]):
        if n_bytes < b:
            part = math.log(n_bytes / a) / math.log(b / a)
            return low + part * (low_b - low), high + part * (high_b - high)
    return BANDS[-1][1:]


def ratios(data: bytes) -> tuple[float, float, bool]:
    """The ratio of the whole text, the share of its bytes in chunks outside their bands, and whether both pass."""
    import zstandard

    if not data:
        return 0.0, 0.0, True
    c = zstandard.ZstdCompressor(level=LEVEL)

    def inside(part: bytes, ratio: float) -> bool:
        low, high = limits(len(part))
        return low <= ratio <= high

    whole = len(c.compress(data)) / len(data)
    bad = 0
    if len(data) > CHUNK_BYTES:
        for i in range(0, len(data), CHUNK_BYTES):
            part = data[i:i + CHUNK_BYTES]
            bad += 0 if inside(part, len(c.compress(part)) / len(part)) else len(part)
    return whole, bad / len(data), inside(data, whole) and bad <= CHUNK_SHARE * len(data)


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, bad_chunks, in_bands of one text."""
    import numpy as np

    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    ids: dict[bytes, int] = {}
    parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
             for words in word_pieces(data)]
    a = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(a), len(text) - int(counts[[9, 10, 11, 12, 13, 32]].sum()),
            int(counts[np.frombuffer(SYMBOLS, np.uint8)].sum()), len(lines) - len(set(lines)),
            repeated_words(a), *ratios(data))


def apply(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: the counts, ``ratio``, ``bad_chunks``, ``base_failed`` and ``kept``."""
    kind = df.schema["doc_id"].dataType.simpleString()
    out = map_rows(df.select(F.col(text).alias("_text"), "doc_id"), lambda t, i: (i, *measure(t)),
                   f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                   "n_repeat_words bigint, ratio double, bad_chunks double, in_bands boolean")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio",
                      "bad_chunks", failed.alias("base_failed"), (~failed & F.col("in_bands")).alias("kept"))
