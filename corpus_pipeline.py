"""The corpus pipeline: stages over `documents`, each one of the operators in jurybox.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurybox.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from jurybox.llm.common import settle
from jurybox.llm.queries import END_OF_PACKED, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group linked by 5-word shingles at 0.8."""
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind, n_chars counted anew."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary(), END_OF_PACKED)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination),
    ("pii", personal_data), ("best_fit_packing", packed),
]
ORACLE_SQL: str | None = None  # tokens and the free numbers of sequences are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
