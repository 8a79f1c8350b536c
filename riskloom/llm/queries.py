"""The registered queries of this subpackage: thin wrappers that derive the result columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    alignment,
    conversations,
    decontamination,
    jaccard_join,
    langid,
    licenses,
    packing,
    quality_model,
    quality_rules,
    secrets,
    simhash,
    toxicity,
    warc,
)
from riskloom.sources.tables import read_table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return jaccard_join.similar_components(docs, width=4, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return toxicity.toxicity_report(docs, read_table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules_report(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return decontamination.contamination_report(docs, read_table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return quality_model.quality_report(docs, read_table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(read_table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scans": op6_license_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
