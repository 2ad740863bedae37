"""Named relations over posts and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.schema import FULL_VIEW, IMAGE_KEY, META_VIEW
from postlens.sources.layout import broadcast_if_small


def with_names(
    facts: DataFrame, boards: DataFrame, platforms: DataFrame, types: DataFrame | None = None
) -> DataFrame:
    """Resolve the ids of a fact table to board, platform and type names.

    Pass stored dimensions: each is broadcast if it is small, and joined by a shuffle if not.
    """
    def names(dimension: DataFrame, key: str, name: str) -> DataFrame:
        return dimension.select(F.col("uid").alias(key), F.col("name").alias(name))

    named = facts.join(broadcast_if_small(names(platforms, "platform_uid", "platform")), "platform_uid")
    if types is not None:
        named = named.join(broadcast_if_small(names(types, "type_uid", "post_type")), "type_uid")
    return named.join(broadcast_if_small(names(boards, "board_uid", "board")), "board_uid")


def full_view(posts: DataFrame) -> DataFrame:
    return posts.select(*FULL_VIEW)


def meta_view(posts: DataFrame) -> DataFrame:
    """Without the text columns, which a columnar scan then never reads."""
    return posts.select(*META_VIEW)


def of_platform(posts: DataFrame, platform: str) -> DataFrame:
    return posts.where(F.col("platform") == platform)


def images_with_data(
    images: DataFrame, thumbs: DataFrame, image_data: DataFrame
) -> DataFrame:
    """Catalogue plus thumbnail and image bytes where there are any."""
    thumb = thumbs.select(*IMAGE_KEY, F.col("data").alias("thumb_data"))
    image = image_data.select(*IMAGE_KEY, F.col("data").alias("image_data"))
    return images.join(thumb, IMAGE_KEY, "left").join(image, IMAGE_KEY, "left")


def archives_with_gb(archives: DataFrame) -> DataFrame:
    """Archive size in whole gigabytes, rounded down."""
    return archives.withColumn("size_gb", F.expr("size div 1073741824"))
