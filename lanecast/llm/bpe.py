"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The rank file gives the vocabulary; the merge list that the library needs follows from it (each token is split at the
last merge that its ranks allow). Texts are split by the public pattern, each distinct pre-token is encoded once and
kept in a bounded cache, and a text's ids are the joined ids of its pre-tokens. Texts below U+0558 (Latin, Greek,
Cyrillic) are split by ``re`` with the pattern's letter and number classes written out for that range, which is faster;
texts with a character from there on are split by the library itself, as Unicode versions differ there.

Offsets come from a byte-to-character map of the text: a token that holds only a part of a character spans the whole
character. Decoding reverses the byte table; ``decoded`` has the bytes, and where ids cut a character its bytes become
U+FFFD in ``decoded_text`` only.

Defined results: a null text counts as empty and gives no ids; rows come one for one, with their ids kept, repeated or
null ids included; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanecast.llm.common import map_rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of pre-tokens and ids that a worker keeps between texts (about 300,000 words); beyond that it starts anew.
CACHE_BYTES = 32 << 20
#: From this character on the pre-token pattern is left to the tokenizers library.
LIBRARY_FROM = 0x558
LIBRARY_ONLY = re.compile(f"[{chr(LIBRARY_FROM)}-\U0010ffff]")
#: Fixed by the pattern: white space below LIBRARY_FROM, and its first alternatives in a shorter form.
WHITE = "\\t-\\r \\x85\\xa0"
CONTRACTIONS = ("'s|'t|'re|'ve|'m|'ll|'d", "'(?:[stmd]|re|ve|ll)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _class(kind: str) -> str:
    """The characters below ``LIBRARY_FROM`` of a major Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(LIBRARY_FROM) if unicodedata.category(chr(c))[0] == kind)


def short_pattern(pattern: str) -> re.Pattern:
    """The public pattern for ``re``, for texts of characters below ``LIBRARY_FROM``."""
    letters, numbers = _class("L"), _class("N")
    for old, new in (CONTRACTIONS, (r"[^\s\p{L}\p{N}]", f"[^{WHITE}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"),
                     (r"\p{N}", f"[{numbers}]"), (r"(?!\S)", f"(?![^{WHITE}])"), (r"\s", f"[{WHITE}]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, in order of rank; tokens that no merge makes are left out."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1)
                        if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """One vocabulary in one worker."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(path)
        letters = byte_letters()
        name = lambda b: "".join(letters[x] for x in b)
        self.tokenizer = Tokenizer(models.BPE({name(b): i for b, i in ranks.items()},
                                              [(name(a), name(b)) for a, b in merges(ranks)], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pattern = short_pattern(public_tokenizers.PATTERN)
        back = {c: b for b, c in letters.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        if LIBRARY_ONLY.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each pre-token."""
        import numpy as np

        try:
            return list(map(self.cache.__getitem__, pieces))
        except KeyError:
            pass
        new = list(set(pieces).difference(self.cache))
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[piece] = ids = np.array(e.ids, "<u4").tobytes()
                self.held += sys.getsizeof(piece) + sys.getsizeof(ids)
        known = list(map(self.cache.__getitem__, pieces))
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        return known

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self._known(self.pieces(text))) if text else b""

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        return [len(x) // 4 for x in self._known(pieces)]

    def decode(self, ids: bytes | None) -> bytes:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    def offsets(self, text: str | None, ids: bytes) -> tuple[list[int], list[int]]:
        """Start and end character of every token; a part of a character spans all of it."""
        import numpy as np

        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        end = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        return char_of[start].tolist(), (char_of[end - 1] + 1).tolist()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _kinds(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, offsets: bool = True,
           vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` (default doc_id), ``n_tokens``, ``ids`` (packed little-endian u32) and ``starts``, ``ends``."""
    keep = ["doc_id"] if keep is None else keep

    def row(t, *k):
        c = codec(vocabulary_path(vocabulary))
        ids = c.encode(t)
        return (*k, len(ids) // 4, ids, *(c.offsets(t, ids) if offsets else ()))

    return map_rows(df.select(F.col(text).alias("_text"), *keep), row, _kinds(df, keep) + "n_tokens bigint, ids binary"
                    + ", starts array<int>, ends array<int>" * offsets)


def decode(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, as_text: bool = True,
           vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep``, ``decoded`` (bytes) and ``decoded_text`` of packed ids."""
    keep = ["doc_id"] if keep is None else keep

    def row(x, *k):
        data = codec(vocabulary_path(vocabulary)).decode(x)
        return (*k, data, *([data.decode("utf-8", "replace")] if as_text else []))

    return map_rows(df.select(F.col(ids).alias("_ids"), *keep), row,
                    _kinds(df, keep) + "decoded binary" + ", decoded_text string" * as_text)


def encode_and_decode(df: DataFrame, text: str = "text", keep: list[str] | None = None,
                      vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids`` and ``decoded``: ``encode`` and ``decode`` of its ids in one pass."""
    keep = ["doc_id"] if keep is None else keep

    def row(t, *k):
        c = codec(vocabulary_path(vocabulary))
        ids = c.encode(t)
        return (*k, len(ids) // 4, ids, c.decode(ids))

    return map_rows(df.select(F.col(text).alias("_text"), *keep), row,
                    _kinds(df, keep) + "n_tokens bigint, ids binary, decoded binary")


def round_trip(df: DataFrame, text: str = "text") -> DataFrame:
    """Digests of ids and decoded bytes: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return encode_and_decode(df, text).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                              F.sha2("decoded", 256).alias("decoded_sha256"))


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """``round_trip`` with the offsets and the decoded text: ``doc_id, n_tokens, ids_sha256, decoded_sha256,
    offsets_sha256, n_replaced``.

    ``offsets_sha256`` is of the starts, then the ends of all tokens in characters (little-endian u32); ``n_replaced``
    counts the replacement characters of the decoded text.
    """
    kind = df.schema["doc_id"].dataType.simpleString()

    def row(t, doc_id):
        import hashlib

        import numpy as np

        c = codec(vocabulary_path(VOCABULARY))
        ids = c.encode(t)
        data = c.decode(ids)
        places = b"".join(np.asarray(x, "<u4").tobytes() for x in c.offsets(t, ids))
        said = [hashlib.sha256(x).hexdigest() for x in (ids, data, places)]
        return doc_id, len(ids) // 4, *said, data.decode("utf-8", "replace").count("\ufffd")

    return map_rows(df.select(F.col(text).alias("_text"), "doc_id"), row, f"doc_id {kind}, n_tokens bigint, "
                    "ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_replaced bigint")
