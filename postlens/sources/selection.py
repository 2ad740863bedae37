"""Which files of which source take part in a load, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.schema import BOARD_PLATFORM, FORUM_PLATFORM

# Source names in their priority when copies of a post collide.
SOURCES = ["research", "forum", "board"]


def source_kind(source, name):
    """Reader kind of a file, by source and file name."""
    return (
        F.when((source == "research") & name.contains("_" + BOARD_PLATFORM), "research_board")
        .when((source == "research") & name.contains("_" + FORUM_PLATFORM), "research_forum")
        .when((source == "forum") & name.endswith("submissions.gz"), "submissions")
        .when(source == "forum", "comments")
        .when(source == "board", "board_dump")
    )


def select_files(
    files: DataFrame, skip: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """``files(source, path)`` without skipped sources and excluded names, with kind and order.

    ``position`` ranks files inside their source by name; together with ``source_rank`` it is
    the order in which copies win.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return (
        files.where(~F.col("source").isin(skip or []))
        .withColumn("name", name)
        .where(~F.col("name").isin(exclude or []))
        .withColumn("kind", source_kind(F.col("source"), F.col("name")))
        .where(F.col("kind").isNotNull())
        .withColumn("source_rank", rank.cast("int"))
    )


def list_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """``(source, path)`` of every file directly inside the source folders."""
    listed = [
        spark.read.format("binaryFile").load(folder)
        .select(F.lit(source).alias("source"), "path")
        for source, folder in folders.items()
    ]
    out = listed[0]
    for more in listed[1:]:
        out = out.unionByName(more)
    return out
