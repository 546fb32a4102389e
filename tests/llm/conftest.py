import pytest

LONG = "the quick brown fox jumps over lazy dogs " * 8000
CLASH = ["score", "fp", "row_uid", "uid", "k1", "key_a", "words", "shard", "slot", "_text", "raw", "x", "h", "edits_"]


def rows_of(texts):
    """Documents of (doc_id, text, lang, source, n_chars)."""
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, clash=False):
        df = spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string, n_chars long")
        for c in CLASH if clash else []:
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit("7"))
        return df
    return make


@pytest.fixture(scope="session")
def edge_texts():
    """Null ids and texts, empty and blank texts, a very long one, ties and repeated rows."""
    return [(1, "Plain words stand here, and they are few."), (1, "Plain words stand here, and they are few."),
            (2, None), (3, ""), (4, " \n\t "), (None, "a text of a row without an id"), (None, None), (5, LONG),
            (6, LONG), (7, "ÄÖ 中文 😀 \x1c  mixed"), (8, 'token = "0123456789abcdef0123456789abcdef01234567"')]
