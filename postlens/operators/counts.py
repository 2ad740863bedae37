"""Descriptive counts over posts and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.fields import day, utc_text
from postlens.schema import BOARD_PLATFORM, FORUM_PLATFORM, REFERENCE_PREFIX


def counts_per_board(posts: DataFrame) -> DataFrame:
    return (
        posts.groupBy("board", "platform").agg(F.count("*").alias("count_posts"))
        .orderBy(F.desc("count_posts"), "board", "platform")
    )


def counts_per_platform(posts: DataFrame) -> DataFrame:
    return posts.groupBy("platform").agg(F.count("*").alias("count_posts"))


def counts_with_samples(totals: DataFrame, sample_sizes: DataFrame) -> DataFrame:
    """Platform counts plus one row ``sample_<platform>`` for each sample."""
    return totals.unionByName(
        sample_sizes.select(
            F.concat(F.lit("sample_"), "platform").alias("platform"),
            F.col("sample_size").alias("count_posts"),
        )
    )


def day_columns(first: str, second: str, sampled: Column) -> dict[str, Column]:
    """Name and condition of the six counts of a day."""
    platform = F.col("platform")
    columns = {}
    for name in (first, second):
        columns[f"count_{name}"] = platform == name
        columns[f"count_{REFERENCE_PREFIX}{name}"] = platform == REFERENCE_PREFIX + name
        columns[f"count_sample_{name}"] = (platform == name) & sampled
    return columns


def posts_per_day(
    posts: DataFrame, first: str = BOARD_PLATFORM, second: str = FORUM_PLATFORM, spine: str = "all"
) -> DataFrame:
    """Six counts per day in one pass over ``posts(platform, timestamp, in_sample)``.

    ``spine='first'`` keeps only the days on which the first platform has posts.
    """
    columns = day_columns(first, second, F.col("in_sample"))
    daily = (
        posts.groupBy(day(F.unix_seconds("timestamp")).alias("date"))
        .agg(*[F.count_if(hit).alias(name) for name, hit in columns.items()])
    )
    return with_spine(daily, first, spine)


def with_spine(daily: DataFrame, first: str, spine: str) -> DataFrame:
    """Days that count at all, or those of the first platform, in order."""
    if spine == "first":
        daily = daily.where(F.col(f"count_{first}") > 0)
    else:
        daily = daily.where(" + ".join(f"`{c}`" for c in daily.columns if c != "date") + " > 0")
    return daily.orderBy("date")


def load_summary(posts: DataFrame) -> DataFrame:
    """Rows, characters of text and time span that a load brings per platform and board."""
    epoch = F.unix_seconds("timestamp")
    return posts.groupBy("platform", "board").agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(F.char_length("body")), F.lit(0)).alias("body_chars"),
        F.min(epoch).alias("first_epoch"),
        F.max(epoch).alias("last_epoch"),
    )


def image_count(images: DataFrame, board: str) -> DataFrame:
    return images.where(F.col("board") == board).agg(F.count("image_id").alias("count_images"))


def image_time_span(images: DataFrame, board: str) -> DataFrame:
    span = images.where(F.col("board") == board).agg(
        F.min("image_id").alias("low"), F.max("image_id").alias("high")
    )
    return span.select(
        utc_text(F.expr("low div 1000")).alias("first"),
        utc_text(F.expr("high div 1000")).alias("last"),
    )


def images_per_day(images: DataFrame, board: str) -> DataFrame:
    return (
        images.where(F.col("board") == board)
        .groupBy(day(F.expr("image_id div 1000")).alias("date"))
        .agg(F.count("image_id").alias("count_per_day"))
        .orderBy("date")
    )
