"""Chat formatting by token-level assembly: segments encoded on their own, reserved ids spliced in between.

The template (``CONTROLS``; each control string is one reserved id behind the vocabulary):

    <s>                                start of a conversation
    [SYS] text [/SYS]                  system turn          (no spaces are added)
    [INST] text [/INST]                user turn
    text </s>                          assistant turn
    [ROLE] role [/ROLE] text [/TURN]   turn of any other role

Texts are escaped before they are encoded: in whatever looks like a control string, with any number of backslashes
after its bracket, one backslash is added (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``). So no text can
make a control string, in ids or in the formatted text, and taking one backslash off gives the text back.

1. Each turn is encoded where its row lies. Only the packed ids are shuffled, so the work of a long conversation is
   spread; the template needs no other turn.
2. A conversation's turns are put together in order of ``turn`` (ties: role, then ids). Running sums of the segment
   lengths give every segment's place, and the running sum of the marks at the ends of the learnt segments is the loss
   mask. The mask covers the assistants' texts; ``learn_end`` adds their ``</s>``.
3. A conversation gives one row per ``ROW_TOKENS`` ids, so a task holds a bounded part of it and one turn.
4. ``read_back`` recovers turns and learnt texts from ids and mask alone.

Defined results: a null text counts as empty, a null role as the role of an empty name; rows without a conv_id make one
conversation; rows without a turn come first; repeated rows are turns of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.llm.bpe import VOCABULARY, read_ranks, vocabulary_path

CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]")
START, END, SYS, SYS_END, INST, INST_END, ROLE, ROLE_END, TURN_END = range(len(CONTROLS))
#: What ends a turn, and whose turn it was; None: the role is told.
ENDS = {END: "assistant", SYS_END: "system", INST_END: "user", TURN_END: None}
#: A control string with any number of backslashes after its bracket.
LOOKALIKE = re.compile(r"([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|/TURN\])")
#: Ids of an output row at most, but for the end of its last turn.
ROW_TOKENS = 1 << 18
#: Characters encoded at a time, cut before a space that a letter follows (a pre-token begins there).
PIECE = 1 << 20
CUT = re.compile(r"(?<=\w) (?=\w)")


def escape(text: str) -> str:
    return LOOKALIKE.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    def less(m: re.Match) -> str:
        return m[1] + m[2][1:] + m[3]

    return LOOKALIKE.sub(less, text) if "\\" in text else text


class Template:
    """The vocabulary with the reserved ids."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(vocabulary_path(name))
        self.base = max(ranks.values()) + 1
        #: Packed ids take two bytes where the vocabulary allows it.
        self.packed = "<u2" if self.base + len(CONTROLS) <= 1 << 16 else "<u4"
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * self.base
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        while at < len(text):
            m = CUT.search(text, at + PIECE)
            stop = m.start() if m else len(text)
            out += self.encoding.encode_ordinary(text[at:stop])
            at = stop
        return out

    def segments(self, role: str, text: str) -> list[tuple[list[int], int]]:
        """The turn as ``(ids, what it is)``: 0 not learnt, 1 learnt text, 2 end of a learnt text."""
        c = self.base
        body = self.encode(escape(text))
        if role == "assistant":
            return [(body, 1), ([c + END], 2)]
        if role == "user":
            return [([c + INST], 0), (body, 0), ([c + INST_END], 0)]
        if role == "system":
            return [([c + SYS], 0), (body, 0), ([c + SYS_END], 0)]
        return [([c + ROLE], 0), (self.encode(escape(role)), 0), ([c + ROLE_END], 0), (body, 0), ([c + TURN_END], 0)]

    def text(self, ids) -> str:
        """The formatted text of whole segments, with the control strings."""
        return b"".join(CONTROLS[i - self.base].encode() if i >= self.base else self.bytes_of[i] for i in ids).decode()


@lru_cache(maxsize=2)
def template(name: str = VOCABULARY) -> Template:
    return Template(name)


def encoded_turns(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id, turn, role, ids, sizes, kinds`` per row: packed ids, and length and kind of each segment."""
    conv, turn = (df.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    out = f"conv_id {conv}, turn {turn}, role string, ids binary, sizes array<int>, kinds array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = template(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids, sizes, kinds = [], [], []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    segments = t.segments(role or "", text or "")
                    ids.append(b"".join(np.asarray(x, t.packed).tobytes() for x, _ in segments))
                    sizes.append([len(x) for x, _ in segments])
                    kinds.append([k for _, k in segments])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(ids, pa.binary()),
                     pa.array(sizes, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int32()))],
                    names=["conv_id", "turn", "role", "ids", "sizes", "kinds"])

    return df.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, out)


def formatted(df: DataFrame, vocabulary: str = VOCABULARY, learn_end: bool = False, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """``conv_id, part, start, ids, loss_mask``: the assembled conversations, ``part`` from 0, ``start`` in ids.

    The rows of a conversation lie in one partition, in order.
    """
    conv = df.schema["conv_id"].dataType.simpleString()
    learnt = (1, 2) if learn_end else (1,)
    turns = (encoded_turns(df, vocabulary).repartition("conv_id")
             .sortWithinPartitions(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("ids")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = template(vocabulary)
        start_id = np.array([t.base + START], t.packed)
        opened, now = False, None
        part, start, held, marks, size = 0, 0, [], [], 0

        def row():
            """The ids so far and their mask: the running sum of +1 where a learnt segment starts, -1 behind it."""
            ids = np.concatenate(held)
            steps = np.zeros(size + 1, np.int64)
            for a, b in marks:
                steps[a] += 1
                steps[b] -= 1
            mask = np.cumsum(steps)[:-1]
            return pa.RecordBatch.from_arrays(
                [pa.array([now], conv_type), pa.array([part], pa.int64()), pa.array([start], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(ids.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(mask.astype(np.int8)))],
                names=["conv_id", "part", "start", "ids", "loss_mask"])

        for b in batches:
            conv_type = b.schema.field(0).type
            for conv_id, ids, sizes, kinds in zip(*(b.column(c).to_pylist() for c in (0, 3, 4, 5))):
                if not opened or conv_id != now:
                    if opened:
                        yield row()
                    opened, now, part, start, held, marks, size = True, conv_id, 0, 0, [start_id], [], 1
                elif size >= row_tokens:
                    yield row()
                    part, start, held, marks, size = part + 1, start + size, [], [], 0
                ends = size + np.cumsum(sizes)          # the segments' places
                marks += [(int(e) - n, int(e)) for e, n, kind in zip(ends, sizes, kinds) if kind in learnt]
                held.append(np.frombuffer(ids, t.packed))
                size = int(ends[-1])
        if opened:
            yield row()

    return turns.mapInArrow(run, f"conv_id {conv}, part long, start long, ids array<int>, loss_mask array<tinyint>")


class Reader:
    """One conversation read from its ids and mask: digests of its turns and of the text under the mask."""

    def __init__(self, t: Template):
        self.t = t
        self.n_turns = self.chars = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.role = ""

    def feed(self, ids, mask) -> Iterator[tuple[str, str]]:
        """The turns within an output row (arrays of ids and mask), as ``(role, text)``."""
        import numpy as np

        at = 0
        for stop in np.flatnonzero(ids >= self.t.base).tolist():
            control = int(ids[stop]) - self.t.base
            body = self.t.encoding.decode_bytes(ids[at:stop].tolist()).decode()
            text = unescape(body)
            self.chars += len(CONTROLS[control]) + len(body)
            learnt = mask[at:stop].astype(bool)
            if learnt.any():
                said = text if learnt.all() else unescape(
                    self.t.encoding.decode_bytes(ids[at:stop][learnt].tolist()).decode())
                self.loss_chars += len(said)
                self.loss.update(said.encode())
            if control == ROLE_END:
                self.role = text
            elif control in ENDS:
                role = ENDS[control] or self.role
                self.n_turns += 1
                self.turns.update(f"{role}\n{text}\n".encode())
                yield role, text
            at = stop + 1

    def report(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of ``formatted`` that were stored, as ``read_back`` and ``turns`` need them."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def _read(rows: DataFrame, vocabulary: str, out: str, each, last) -> DataFrame:
    """``each(conv_id, turns)`` per row and ``last(conv_id, reader)`` per conversation, as tuples of ``out``."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(out)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        reader, now = None, None

        def made(tuples):
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*tuples), kinds)], schema=kinds)

        for b in batches:
            held = []
            for i in range(b.num_rows):          # a row at a time: each has many ids
                conv_id, part = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids, mask = (b.column(c)[i].values.to_numpy() for c in (2, 3))
                if part == 0:
                    if reader:
                        held += last(now, reader)
                    reader, now = Reader(template(vocabulary)), conv_id
                held += each(conv_id, reader.feed(ids, mask))
            if held:
                yield made(held)
        if reader and (held := last(now, reader)):
            yield made(held)

    return rows.select("conv_id", "part", "ids", "loss_mask").mapInArrow(run, schema)


def read_back(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of ``formatted`` conversations."""
    def each(conv_id, turns):
        for _ in turns:
            pass
        return []

    out = (f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
           "loss_chars long, loss_sha256 string, formatted_chars long")
    return _read(rows, vocabulary, out, each, lambda conv_id, reader: [(conv_id, *reader.report())])


def turns(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id, role, text`` of every turn of ``formatted`` conversations, in order."""
    out = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, role string, text string"
    return _read(rows, vocabulary, out, lambda conv_id, found: [(conv_id, *x) for x in found], lambda *_: [])


def control_turns(spark: SparkSession) -> DataFrame:
    """Fixed by the contract: conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")


def report(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The digests of all ``conversations`` and of conversation -7, read back from their ids and masks."""
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(control_turns(conversations.sparkSession))
    return read_back(formatted(rows, vocabulary), vocabulary)
