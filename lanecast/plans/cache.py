"""Per-session memo of derived tables shared by several registered queries.

Keyed by the Spark application id, so a new session never sees another session's
data, and valid only while the input folder's files are the same (names, sizes, times).
Entries are stored DataFrames derived from the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

_MEMO: dict = {}


def folder_state(spark, folder: str) -> tuple:
    """Name, size and modification time of the folder's entries, read through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def memo(spark, key: tuple, build: Callable):
    """``build()`` once per (session, key); ``key[1]`` is the folder it reads."""
    k = (spark.sparkContext.applicationId, *key)
    state = folder_state(spark, key[1])
    if k not in _MEMO or _MEMO[k][0] != state:
        _MEMO[k] = (state, build())
    return _MEMO[k][1]


def clear() -> None:
    _MEMO.clear()
