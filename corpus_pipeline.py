"""The corpus pipeline: five of the training-data operators, one after the other, over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. Rejected documents, near lines, near copies and documents with benchmark items go; the last stage encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanset.llm import decontaminate, line_dedup, near_dedup, piece_codec, quality_rules
from gleanset.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go, and rejected documents."""
    return quality_rules.keep_clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each component of near lines the first stays."""
    return line_dedup.without_near_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles: of each component of documents the one with the least id stays."""
    return near_dedup.keep_first(docs, near_dedup.Near(shingle=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: each document's ids, checked by decoding them."""
    return piece_codec.sentence_pieces(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("sentence_pieces", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is a table in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
