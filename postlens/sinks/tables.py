"""Stored tables and exports. Every write is done by all tasks in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS_SCHEMA = """
    uid long, post_id string, timestamp timestamp, thread_id string, thread_uid long,
    parent_id string, parent_uid long, author string, subject string, body string,
    extras string, board string, post_type string, added timestamp, source_file string,
    dl int, platform string, month string
"""
STATISTICS_SCHEMA = "platform string, board string, date string, posts long, tokens long, load_id string"
HIT_ROWS_SCHEMA = """
    uid long, post_id string, timestamp timestamp, thread_id string, thread_uid long,
    parent_id string, parent_uid long, author string, board string, platform string,
    post_type string, rank double, subject string, extras string, body string,
    in_all boolean, in_qanon boolean, in_sample boolean, spans int, index string
"""


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a table with at least one file?"""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True)
                    .option("pathGlobFilter", "*.parquet").load(path).select("path").take(1))
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def write_partitioned(
    rows: DataFrame, path: str, by: list[str], mode: str, order: list[str] | None = None
) -> None:
    """Write a table partitioned by ``by``, each file sorted by ``order``.

    The rebalance hint brings rows of a partition together into files of sensible size and
    splits a partition that holds far more than others over several tasks.
    """
    spread = rows.hint("rebalance", *by)
    if order:
        spread = spread.sortWithinPartitions(*by, *order)
    spread.write.mode(mode).partitionBy(*by).parquet(path)


def store_posts(posts: DataFrame, path: str) -> None:
    dated = posts.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    write_partitioned(dated, path, ["platform", "month"], "append")


def stored_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTS_SCHEMA).parquet(path)


def stored_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The partial counts of all loads."""
    return spark.read.schema(STATISTICS_SCHEMA).parquet(path).drop("load_id")


def store_hit_rows(rows: DataFrame, path: str) -> None:
    """One folder per marker, so that a drill-down reads only its own files.

    Rows of a scope are next to one another, best rank first: a reader of one scope skips the row
    groups of the others.
    """
    write_partitioned(rows, path, ["index"], "overwrite", ["in_sample", "in_all", "in_qanon", "rank", "uid"])


def stored_hit_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HIT_ROWS_SCHEMA).parquet(path)


def export_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = (rows.hint("rebalance", *by).write.partitionBy(*by) if by else rows.write)
    writer.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """With header; quotes inside fields are doubled, array columns must be left out."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
