"""Registered queries of the training-data operators: whole tables, production parameters, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.llm import (bpe, chat, decontaminate, language, lexical_search, licenses, quality, quality_rules, secrets,
                          sharding, simhash, spelling, token_counts)
from lanecast.llm.common import table


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and zstandard bands of every text, and whether it is kept."""
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of documents: fingerprints of 3-word shingles, linked at two or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, groups of equal texts kept whole."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by a bidirectional GRU over its bytes, learnt from the other folds."""
    return language.detect(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, their offsets and their decoding, as counts and digests."""
    return bpe.report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from its text, learnt from the labels of the other folds."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text before and after edits, which are drawn as the tables hold none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs.withColumn("edits", token_counts.drawn_edits(F.col("doc_id"), F.col("text"))))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: fixed patterns, and formats learnt from them."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices contained in documents, one row per document and licence."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents, one row per document and item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item, by the Best Position Algorithm."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and the frequent form that each varies."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as ids with a loss mask, read back as digests."""
    return chat.report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_compression_bands": op1_compression_bands,
    "op2_simhash": op2_simhash,
    "op3_differencing": op3_differencing,
    "op4_byte_gru": op4_byte_gru,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scans": op8_secret_scans,
    "op9_license_scans": op9_license_scans,
    "op10_decontaminate": op10_decontaminate,
    "op11_best_position": op11_best_position,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_format": op13_chat_format,
}
ORACLES = {"op9_license_scans": licenses.oracle(), "op10_decontaminate": decontaminate.ORACLE,
           "op11_best_position": lexical_search.ORACLE}
