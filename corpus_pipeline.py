"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terramark.llm import exact_dedup, language_id, mixing, near_copies, sentencepiece


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang holds the prediction."""
    return language_id.identified(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word Jaccard similarity 0.8; op5 has its own, stricter rule."""
    return near_copies.deduplicated(docs)


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.tokenised(docs)


#: (name, function); each takes (spark, docs, sf_dir), its docs are what the one before it returned.
STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", keep_one_copy),
    ("simhash", keep_one_of_near_copies),
    ("mixing", keep_mixture),
    ("sentencepiece", tokenise),
]

#: Language models, fingerprints and Viterbi paths are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
