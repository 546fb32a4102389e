"""Helpers shared by the training-data operators: table reads, Arrow maps, stored intermediates, word rules."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanecast.session import ensure_checkpoint_dir

#: Fixed by the contracts: words are runs of characters other than the six ASCII white-space characters.
SPACES = "\\x20\\x09-\\x0D"
WORD_BREAK = re.compile(rb"[\x20\x09-\x0D]")
ASCII_LOWER = bytes(range(256)).lower()
#: Bytes of text taken at a time where a step cuts a text into words (bounds memory on very long texts).
PIECE_BYTES = 1 << 20


#: Rows of an Arrow batch between the JVM and Python; texts are long, so the default of 10,000 makes large batches.
BATCH_ROWS = "1024"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; unless the session sets the rows of its Arrow batches, they hold ``BATCH_ROWS`` now on.

    Spark reads this setting when a query runs, so it cannot be given per operator.
    """
    if spark.conf.get(ARROW_ROWS, "0") == "0":
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again.

    Later steps read only the columns that they need, and a lost executor loses none of it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that an Arrow map takes and hands back at a time.
SLICE_ROWS = 256


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, fn: Callable, out: str) -> DataFrame:
    """Arrow map: ``fn(*column values) -> tuple`` per row; ``out`` is the DDL of the returned columns.

    Batches come as Spark cuts them and go back in slices of ``SLICE_ROWS`` rows; a null value arrives as None.
    """
    schema = StructType.fromDDL(out)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                rows = [fn(*r) for r in zip(*(c.to_pylist() for c in b.slice(at, SLICE_ROWS).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)],
                                                 schema=kinds)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, as lists that each come from about ``size`` bytes."""
    at = 0
    while at < len(data):
        cut = len(data)
        if at + size < len(data):
            m = WORD_BREAK.search(data, at + size)
            cut = m.start() if m else len(data)
        yield data[at:cut].split()
        at = cut
