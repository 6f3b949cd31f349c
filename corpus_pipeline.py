"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. Stages lower the session's rows of an Arrow batch
(small_batches), as documents of any length stand in them.

Null texts and texts without a letter go at the first stage; null ids, repeated rows, ties, empty tables and columns
with clashing names pass through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import decontamination, jaccard, language_id, packing, secret_scan
from stowage.session import materialise, release, scratch, small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a language that is likelier than the others together go; a null lang is filled in."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return jaccard.keep_one(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark; all documents stay."""
    small_batches(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: The stages learn models and verify overlaps word by word, which SQL can't express; see tests/llm/.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. What a stage writes for itself goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), keep=True)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
