"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import jaccard, language, mixing, packing, passages
from lexiloom.llm._base import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network gives a language; it is trained on a bounded sample of their lang labels."""
    return language.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of an earlier document are cut out."""
    return passages.cut_repeats(docs)


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources interleaved by their target weights; small sources run for more than one epoch."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("source_mixing", mixed_by_source),
    ("packing", packed),
]

#: The stages' hashes and networks have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
