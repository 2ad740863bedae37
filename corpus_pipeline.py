"""A corpus pipeline of the operators in ``postlens.llm``: each stage works on all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontamination, jaccard, language, line_dedup, packing
from postlens.llm.store import checkpoint_folder, without

# Near-duplicate stages take five words and 0.8.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages."""
    verdicts = language.identify(docs, F.col("lang"), [F.col("source")])
    return without(docs, verdicts.where(~F.col("kept")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that many others share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length.cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.representatives(docs, SHINGLE, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.matches(docs, benchmark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
# Fitted and hashed stages cannot be written as SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next stage."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
