"""Name dimensions: get-or-create ids and the joins to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.numbering import hash_key, number_rows
from postlens.schema import PLATFORMS, POST_TYPES
from postlens.sources.layout import broadcast_if_small


def platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLATFORMS, "uid long, name string, archive string")


def post_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POST_TYPES, "uid long, name string")


def new_names(known: DataFrame, names: DataFrame) -> DataFrame:
    """Names that ``known(uid, name)`` lacks, numbered upwards from its largest id."""
    fresh = (
        names.select("name").where(F.col("name").isNotNull()).distinct()
        .join(known, "name", "left_anti")
        .withColumn("_key", hash_key(F.col("name")))
    )
    numbered = number_rows(fresh, "_key", ["name"], [], "_number")
    largest = known.agg(F.coalesce(F.max("uid"), F.lit(0))).scalar()
    return numbered.select((largest + F.col("_number")).alias("uid"), "name")


def extend_dimension(known: DataFrame, names: DataFrame) -> DataFrame:
    """``known(uid, name)`` plus the new names."""
    return known.select("uid", "name").unionByName(new_names(known, names))


def with_ids(
    posts: DataFrame, boards: DataFrame, platform_dim: DataFrame, type_dim: DataFrame
) -> DataFrame:
    """Replace names by ids. Pass stored dimensions: small ones are broadcast."""
    return (
        posts
        .join(broadcast_if_small(platform_dim.select(
            F.col("uid").alias("platform_uid"), F.col("name").alias("platform"))), "platform")
        .join(broadcast_if_small(type_dim.select(
            F.col("uid").alias("type_uid"), F.col("name").alias("post_type"))), "post_type")
        .join(broadcast_if_small(boards.select(
            F.col("uid").alias("board_uid"), F.col("name").alias("board"))), "board")
        .drop("platform", "post_type", "board")
    )
