"""Intermediate tables in the shared folder, and broadcasts behind a check of their size."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.sources.layout import checkpoint_folder, settled

BROADCAST_BYTES = 8 << 20
ROW_GROUP = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
_WIDTHS = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.BooleanType: 1}

__all__ = ["BROADCAST_BYTES", "checkpoint_folder", "once", "release_shuffles", "sent_if_small", "settled",
           "shuffles_dropped", "small_batches", "whole_texts", "without", "written"]


def whole_texts(spark: SparkSession) -> None:
    """Make the session send rows to Python in batches that whole texts do not swell."""
    spark.conf.set(BATCH, str(min(int(spark.conf.get(BATCH)), BATCH_ROWS)))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Send at most so many rows at a time to Python for what is run inside, then as before."""
    before = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, str(before))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each query that is run inside as soon as it has ended.

    Otherwise they stay until the driver happens to collect the objects that stand for them.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more.

    They go when the driver collects the objects that stand for them, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(rows: DataFrame) -> DataFrame:
    """Write rows as Parquet beside the checkpoints and read them back: columns can be pruned."""
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)  # a writer buffers one row group
    return spark.read.schema(rows.schema).parquet(path)


def sent_if_small(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table of numbers and short texts for broadcast if all its bytes fit the limit.

    A larger one is left alone: the join shuffles, and skewed keys are split at run time.
    """
    texts = [F.octet_length(f.name) for f in rows.schema if isinstance(f.dataType, T.StringType)]
    width = sum(_WIDTHS[type(f.dataType)] for f in rows.schema if not isinstance(f.dataType, T.StringType))
    size = rows.agg(F.sum(F.lit(width) + sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0)))).first()[0]
    return F.broadcast(rows) if (size or 0) <= limit else rows


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents minus those named by (doc_id, body), body being the hash of the text.

    The list is stored first; the texts move only if it is too large to send to all tasks.
    """
    gone = sent_if_small(settled(rejected.select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct()))
    return docs.join(
        gone, (F.xxhash64("text") == F.col("_body"))
        & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti")


def once(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The documents with one row only for each (doc_id, body) that ``named`` holds."""
    again = settled(named.select("doc_id", "body").distinct())
    if again.isEmpty():
        return docs
    many = sent_if_small(again.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")))
    same = (F.xxhash64("text") == F.col("_body")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    first = docs.join(many, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(many, same, "left_anti").unionByName(first)
