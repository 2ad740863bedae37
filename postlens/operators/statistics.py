"""Counts that each load writes and that are merged on reading, instead of a scan of all posts.

A partial table has one row per platform, board and day of a load with the number of posts and their
tokens. Sums of such rows give the descriptive counts and what ranks need to know of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.fields import day
from postlens.operators import counts
from postlens.operators.matching import with_length
from postlens.schema import BOARD_PLATFORM, FORUM_PLATFORM

def partial(posts: DataFrame) -> DataFrame:
    """(platform, board, date, posts, tokens) of some posts; a few rows per task are shuffled."""
    return (
        with_length(posts).groupBy("platform", "board", day(F.unix_seconds("timestamp")).alias("date"))
        .agg(F.count("*").alias("posts"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")))


def counts_per_board(partials: DataFrame) -> DataFrame:
    return (
        partials.groupBy("board", "platform").agg(F.sum("posts").alias("count_posts"))
        .orderBy(F.desc("count_posts"), "board", "platform"))


def counts_per_platform(partials: DataFrame) -> DataFrame:
    return partials.groupBy("platform").agg(F.sum("posts").alias("count_posts"))


def posts_per_day(
    partials: DataFrame, sample: DataFrame, first: str = BOARD_PLATFORM,
    second: str = FORUM_PLATFORM, spine: str = "all",
) -> DataFrame:
    """Like ``counts.posts_per_day``; ``sample(platform, timestamp)`` are the sampled posts."""
    drawn = sample.groupBy("platform", day(F.unix_seconds("timestamp")).alias("date")).agg(
        F.count("*").alias("posts"))
    rows = partials.select("platform", "date", "posts", F.lit(False).alias("drawn")).unionByName(
        drawn.withColumn("drawn", F.lit(True)))
    # A sampled post is in both parts, so the columns of all posts take the first part only.
    columns = {
        name: (~F.col("drawn") & hit) if "_sample_" not in name else (F.col("drawn") & hit)
        for name, hit in counts.day_columns(first, second, F.col("drawn")).items()}
    daily = rows.groupBy("date").agg(*[
        F.sum(F.when(hit, F.col("posts")).otherwise(0)).alias(name) for name, hit in columns.items()])
    return counts.with_spine(daily, first, spine)


def corpus(partials: DataFrame) -> tuple[float, float]:
    """Number of posts and their mean length in tokens."""
    row = partials.agg(F.sum("posts").alias("n"), F.sum("tokens").alias("tokens")).first()
    return float(row.n or 0), (row.tokens / row.n if row.n else 0.0)
