"""Exact-size, reproducible random samples per platform.

A sample of n posts is the n smallest posts of a platform by a seeded hash of the uid. It is
therefore fully described by one cut-off per platform, and membership is a comparison inside
the row: neither drawing nor using a sample sorts or shuffles the posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.numbering import hash_key
from postlens.schema import REFERENCE_PREFIX
from postlens.sources.layout import settled

# Leading hash digits counted in the first and in the second round.
BUCKET_DIGITS = (3, 6)


def sample_key(seed: int) -> Column:
    return hash_key(F.col("uid"), F.lit(seed))


# --- how many ------------------------------------------------------------------------


def matched_sizes(totals: DataFrame) -> DataFrame:
    """As many posts as the reference dataset of the platform has."""
    reference = totals.select(
        F.expr(f"substring(platform, {len(REFERENCE_PREFIX) + 1})").alias("platform"),
        F.col("count_posts").alias("sample_size"),
    ).where(totals["platform"].startswith(REFERENCE_PREFIX))
    return totals.select("platform").join(reference, "platform")


def ratio_sizes(totals: DataFrame, percent: dict[str, int]) -> DataFrame:
    """Whole hundreds of posts times the percentage of the platform."""
    share = F.lit(None).cast("bigint")
    for platform, value in percent.items():
        share = F.when(F.col("platform") == platform, F.lit(value).cast("bigint")).otherwise(share)
    return totals.select(
        "platform", (F.expr("count_posts div 100") * share).alias("sample_size")
    ).where(F.col("sample_size").isNotNull())


def one_percent_sizes(totals: DataFrame) -> DataFrame:
    return totals.select("platform", F.expr("count_posts div 100").alias("sample_size"))


def weighted_sizes(totals: DataFrame, total: int) -> DataFrame:
    """``total`` spread over all platforms by the square root of their sizes."""
    weight = F.sqrt(F.col("count_posts").cast("double"))
    everything = Window.partitionBy()  # one row per platform
    return totals.select(
        "platform",
        F.round(weight / F.sum(weight).over(everything) * total).cast("bigint").alias("sample_size"),
    )


# --- which ---------------------------------------------------------------------------


def cutoffs(posts: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """``(platform, cut_key, cut_uid)``: the last sampled post of each platform by (key, uid).

    Posts are counted per leading hash digits to find the bucket in which the n-th post lies,
    then again inside that bucket with more digits; only the posts of the last, tiny bucket
    (1 in 16,777,216) are ranked. Platforms with fewer posts than asked for get a cut-off
    behind every key. Sizes and border rows are settled, so each round reads the uids once.
    """
    wanted = settled(sizes.where(F.col("sample_size") > 0).select(
        "platform", F.col("sample_size").alias("take")))
    inside = posts.select("platform", "uid", sample_key(seed).alias("key"))
    left = wanted
    for digits in BUCKET_DIGITS:
        inside = inside.withColumn("bucket", F.substring("key", 1, digits))
        left = settled(_border(inside, left))
        # At most one border row per platform, so the broadcast is as small as that list.
        inside = inside.join(
            F.broadcast(left.select("platform", "bucket")), ["platform", "bucket"], "left_semi"
        )
    rank = F.row_number().over(Window.partitionBy("platform").orderBy("key", "uid"))
    last = (
        inside.withColumn("place", rank).join(F.broadcast(left), ["platform", "bucket"])
        .where(F.col("place") == F.col("take"))
        .select("platform", F.col("key").alias("cut_key"), F.col("uid").alias("cut_uid"))
    )
    behind_all = F.lit("g")  # sorts behind every hex digit
    return wanted.select("platform").join(last, "platform", "left").select(
        "platform",
        F.coalesce("cut_key", behind_all).alias("cut_key"),
        F.coalesce("cut_uid", F.lit(0)).alias("cut_uid"),
    )


def _border(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bucket of each platform that holds the wanted place, and the place inside of it."""
    reached = F.sum("n").over(Window.partitionBy("platform").orderBy("bucket"))
    return (
        keyed.groupBy("platform", "bucket").agg(F.count("*").alias("n"))
        .withColumn("reached", reached)
        .join(wanted.select("platform", "take"), "platform")
        .where((F.col("reached") >= F.col("take")) & (F.col("reached") - F.col("n") < F.col("take")))
        .select("platform", "bucket", (F.col("take") - F.col("reached") + F.col("n")).alias("take"))
    )


def flag_sample(posts: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Add ``in_sample``. ``cuts`` has one row per platform and is broadcast."""
    key = sample_key(seed)
    inside = (key < F.col("cut_key")) | (
        (key == F.col("cut_key")) & (F.col("uid") <= F.col("cut_uid"))
    )
    return (
        posts.join(F.broadcast(cuts), "platform", "left")
        .withColumn("in_sample", F.coalesce(inside, F.lit(False)))
        .drop("cut_key", "cut_uid")
    )


def draw(posts: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """Sampled posts, all platforms in one pass."""
    flagged = flag_sample(posts, cutoffs(posts, sizes, seed), seed)
    return flagged.where("in_sample").drop("in_sample")


def sample_uids(posts: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    return draw(posts.select("platform", "uid"), sizes, seed)


def drawn_sizes(totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Size each sample comes out with: as asked for, or the whole platform if it has less."""
    return totals.join(sizes, "platform").select(
        "platform", F.least("sample_size", "count_posts").alias("sample_size"))


def sample_counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy("platform").agg(F.count("*").alias("sample_size"))


def head_and_tail(rows: DataFrame, group: str, order: str, n: int = 1000) -> DataFrame:
    """First n and last n rows of each group; short groups appear twice.

    Each half is a plain top-n per group, which Spark cuts to n rows per task before the
    shuffle, so a group of any size is fine.
    """
    def top(by: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(group).orderBy(by))
        return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

    return top(F.asc(order)).unionByName(top(F.desc(order)))
