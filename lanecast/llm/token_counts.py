"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch it.

A document's leaves are blocks of about ``BLOCK`` pre-tokens; a binary tree over the blocks holds their sums of
characters and tokens. An edit ``(start, cut, put)`` replaces ``cut`` code points from ``start`` (both clipped to the
text) by ``put``; a document's edits apply in order, each to the text that the one before left. The tree finds the
pre-token at ``start``; splitting starts two pre-tokens before it (a match looks at most two characters past its end)
and goes on until a new boundary behind the edit meets an old one, which makes all later pre-tokens the old ones. Only
the new pre-tokens are encoded, the touched blocks change and their sums are carried up the tree.

Defined results: a null text counts as empty; null lists and null edits are no edits; a null ``put`` is empty, a null
or negative ``start`` or ``cut`` is 0, and one past the end is the end; rows come one for one, repeated or null ids
included. Only id, text and edits are read. A document with very many edits is still one task's work, as its edits
depend on one another; documents spread over tasks as the input does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanecast.llm.bpe import VOCABULARY, Codec, codec, vocabulary_path
from lanecast.llm.common import map_rows

BLOCK = 64
#: Pre-tokens that are split again before the edit, and kept out of the end of what was split again.
CONTEXT = 2


class TokenTree:
    """The pre-tokens of one text with their token counts."""

    def __init__(self, text: str, coder: Codec):
        self.coder = coder
        self.encoded_chars = 0
        self._build(coder.pieces(text))

    def _counts(self, pieces: list[str]) -> list[int]:
        self.encoded_chars += sum(map(len, pieces))
        return self.coder.counts(pieces)

    def _build(self, pieces: list[str], counts: list[int] | None = None) -> None:
        counts = self._counts(pieces) if counts is None else counts
        self.pieces = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.counts = [counts[i:i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.size = 1 << (len(self.pieces) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        lengths = list(map(len, pieces))
        for b, c in enumerate(self.counts):
            self.chars[self.size + b], self.tokens[self.size + b] = sum(lengths[b * BLOCK:(b + 1) * BLOCK]), sum(c)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _update(self, b: int) -> None:
        i = self.size + b
        self.chars[i], self.tokens[i] = sum(map(len, self.pieces[b])), sum(self.counts[b])
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(p) for p in self.pieces)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block and index of the pre-token that holds character ``at``, and its start (the end, past the last)."""
        if at >= self.n_chars:
            b = len(self.pieces) - 1
            return b, len(self.pieces[b]), self.n_chars
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if start + self.chars[i] <= at:
                start += self.chars[i]
                i += 1
        b, k = i - self.size, 0
        while start + len(self.pieces[b][k]) <= at:
            start += len(self.pieces[b][k])
            k += 1
        return b, k, start

    def _back(self, b: int, k: int, start: int) -> tuple[int, int, int]:
        """The place ``CONTEXT`` pre-tokens earlier."""
        for _ in range(CONTEXT):
            while k == 0 and b > 0:
                b -= 1
                k = len(self.pieces[b])
            if k:
                k -= 1
                start -= len(self.pieces[b][k])
        return b, k, start

    def edit(self, start: int, cut: int, put: str) -> None:
        start = min(max(start, 0), self.n_chars)
        end = min(start + max(cut, 0), self.n_chars)
        if start == end and not put:
            return
        b0, k0, from_ = self._back(*self._find(start))
        old = self._from(b0, k0)
        head = tail = ""
        ends: dict[int, tuple[int, int]] = {}  # old boundaries at or past the edit's end -> their place
        at, place, want, done = from_, (b0, k0), 8, False
        shift = len(put) - (end - start)
        while True:
            for piece, after in old:  # old pre-tokens, until some lie behind the edit
                if at < start:
                    head += piece[:start - at]
                if at + len(piece) > end:
                    tail += piece[max(0, end - at):]
                if at >= end:
                    ends[at] = place
                at += len(piece)
                place = after
                if at >= end and len(ends) > want:
                    break
            else:
                done = True
                ends[at] = place
            new = self.coder.pieces(head + put + tail)
            sure = len(new) if done else len(new) - CONTEXT - 1
            here, n = from_, 0
            while n < sure and not (here >= start + len(put) and here - shift in ends):
                here += len(new[n])
                n += 1
            if here >= start + len(put) and here - shift in ends:
                return self._replace(b0, k0, ends[here - shift], new[:n])
            want *= 4

    def _from(self, b: int, k: int):
        """Pre-tokens from a place on, each with the place after it."""
        while b < len(self.pieces):
            while k < len(self.pieces[b]):
                k += 1
                yield self.pieces[b][k - 1], (b, k)
            b, k = b + 1, 0

    def _replace(self, b0: int, k0: int, stop: tuple[int, int], new: list[str]) -> None:
        b1, k1 = stop
        counts = self._counts(new)
        if b1 == b0:
            self.pieces[b0][k0:k1], self.counts[b0][k0:k1] = new, counts
        else:
            self.pieces[b0][k0:], self.counts[b0][k0:] = new, counts
            for b in range(b0 + 1, b1):
                self.pieces[b], self.counts[b] = [], []
                self._update(b)
            del self.pieces[b1][:k1], self.counts[b1][:k1]
            self._update(b1)
        self._update(b0)
        if len(self.pieces[b0]) > 8 * BLOCK:  # one block has grown too long: deal the pre-tokens anew
            self._build([p for x in self.pieces for p in x], [c for x in self.counts for c in x])


def count(df: DataFrame, text: str = "text", edits: str = "edits", vocabulary: str = VOCABULARY,
          texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_edits, edited_tokens, edited_chars, reencoded_chars``.

    ``edits`` is ``array<struct<start:int, cut:int, put:string>>``. ``n_tokens`` is the count before the edits;
    ``reencoded_chars`` the characters encoded because of them. ``texts`` adds ``edited_text``.
    """
    def row(t, changes, doc_id):
        tree = TokenTree(t or "", codec(vocabulary_path(vocabulary)))
        before, first = tree.n_tokens, tree.encoded_chars
        todo = [e for e in changes or [] if e is not None]
        for e in todo:
            tree.edit(e["start"] or 0, e["cut"] or 0, e["put"] or "")
        out = (doc_id, before, len(todo), tree.n_tokens, tree.n_chars, tree.encoded_chars - first)
        return (*out, tree.text()) if texts else out

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_rows(df.select(F.col(text).alias("_text"), F.col(edits).alias("_edits"), "doc_id"), row,
                    f"doc_id {kind}, n_tokens bigint, n_edits bigint, edited_tokens bigint, edited_chars bigint, "
                    "reencoded_chars bigint" + ", edited_text string" * texts)


def drawn_edits(doc_id: Column, text: Column, n: int = 4) -> Column:
    """Stand-in edits for a table without any: ``n`` places drawn by hash, each with a piece of the same text."""
    size = F.greatest(F.length(text), F.lit(1))
    draw = lambda i, what, most: F.pmod(F.xxhash64(doc_id, F.lit(i), F.lit(what)), most).cast("int")
    return F.array(*[F.struct(draw(i, "start", size).alias("start"), draw(i, "cut", F.lit(12)).alias("cut"),
                              F.substring(text, draw(i, "from", size) + 1, draw(i, "put", F.lit(24))).alias("put"))
                     for i in range(n)])
