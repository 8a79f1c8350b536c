"""A training-corpus pipeline of five stages over `documents`.

language ID -> near-duplicate join -> benchmark decontamination -> secret redaction -> packing. Every stage takes what the one before
kept and returns the columns of `documents`; the last returns the packed pieces. :func:`run` writes each stage's result as
Parquet to the shared checkpoint folder and reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, jaccard_join, langid, packing, secrets
from riskloom.session import materialise
from riskloom.sources.tables import read_table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the references are learned from the labelled documents that came in.

    A document goes if it has no letter, or if it names a language that is among the learned ones and is told apart from the
    predicted one with a score of at least MIN_SCORE (a mislabelled text)."""
    references = langid.learn_references(docs)
    found, f = langid.identify(docs, references)
    known = F.col("lang").isin(sorted(references)) if references else F.lit(False)
    wrong = known & (F.col(f"{f}.lang_pred") != F.col("lang")) & (F.col(f"{f}.score") >= MIN_SCORE)
    unknown = F.lit(bool(references)) & (F.col(f"{f}.lang_pred") == langid.UNDETERMINED)
    return found.where(~unknown & ~F.coalesce(wrong, F.lit(False))).drop(f)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by 5-word shingles with a Jaccard of 0.8 or more."""
    return jaccard_join.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in the text (and n_chars set anew)."""
    return secrets.redact(docs, length="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in the packed sequences."""
    return packing.pack_documents(docs)


#: A prediction that differs from the document's own language only counts from this score on, so that texts with passages in
#: another language stay (at 0.3, about 0.2 % of the check tables went).
MIN_SCORE = 0.5

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Language identification and tokenised packing can't be expressed in SQL; tests compare with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
