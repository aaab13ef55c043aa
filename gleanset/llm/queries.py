"""The training-data queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.llm import class_lm, common, decontaminate, line_dedup, merkle, near_dedup, piece_codec, quality_rules, rule_ensemble, secret_scan, span_dedup, spelling, url_filter, vectors
from gleanset.llm.common import table
from gleanset.llm.oracle import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = common.held_out(F.col("doc_id"), 5, 1)
    return class_lm.score(docs, class_lm.train(docs, ~out), out)


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.sentence_pieces(table(spark, sf_dir, "documents"), with_ids=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "failed_words")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.written(rule_ensemble.with_statistics(table(spark, sf_dir, "documents")))
    out = common.held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    model = rule_ensemble.fit(stats.filter(~out).join(labels, "doc_id"))
    scored = stats.select("doc_id", out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_class_lm, op2_span_dedup, op3_sentence_pieces, op4_decontaminate, op5_url_filter, op6_near_dedup, op7_quality_rules, op8_quality_classifier, op9_line_dedup, op10_secret_scan, op11_near_vectors, op12_spelling_variants, op13_merkle_manifest)}

