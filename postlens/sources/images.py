"""Archive manifests (XML) and expanded thumbnail folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import fields
from postlens.schema import BOARD_PLATFORM

MANIFEST_ENTRY = "_name string, size string"
# Width of one archive group in the unit of its date bounds.
GROUP_SPAN = 1_000_000
ARCHIVE_SUFFIX = ".tar.gz"
ARCHIVE_NAME = r"^([^-]+)-([0-9]+)\.tar\.gz$"


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file`` elements with the scope taken from ``<scope>_files.xml``."""
    entries = (
        spark.read.format("xml").option("rowTag", "file").schema(MANIFEST_ENTRY).load(paths)
    )
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return entries.withColumn("scope", F.regexp_replace(name, "_files.xml$", ""))


def archive_entries(
    entries: DataFrame, url_prefix: str, platform: str = BOARD_PLATFORM
) -> DataFrame:
    """One archive per manifest entry named ``board-group.tar.gz``."""
    group = F.regexp_extract("_name", ARCHIVE_NAME, 2).cast("bigint")
    return (
        entries.where(F.col("_name").rlike(ARCHIVE_NAME))
        .select(
            F.lit(platform).alias("platform"),
            F.concat(F.lit("/"), F.regexp_extract("_name", ARCHIVE_NAME, 1), F.lit("/")).alias("board"),
            group.alias("group1"),
            (group * GROUP_SPAN).alias("date_from"),
            ((group + 1) * GROUP_SPAN - 1).alias("date_to"),
            F.concat(F.lit(url_prefix), "scope", F.lit("/"), "_name").alias("url"),
            F.trim("size").try_cast("bigint").alias("size"),
        )
    )


def read_thumbnail_files(
    spark: SparkSession, root: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Files below ``<root>/<board>_thumbs/<member path>`` as (archive, member, length, content).

    Which files are thumbnails of the date range is told by their paths alone, so the files are
    chosen from the listing and the bytes of all others are never read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    )
    base = "/" + root.strip("/").split(":/")[-1].strip("/") + "/"

    def member(path) -> Column:
        return F.regexp_replace(F.substring_index(path, base, -1), "^[^/]+/", "")

    image_id = fields.digits(member_name(member(F.col("_metadata.file_path"))))
    chosen = image_id.isNotNull()
    if start is not None or end is not None:
        chosen &= fields.within(F.floor(image_id / 1000), start, end)
    return files.where(chosen).select(
        F.substring_index(F.substring_index("path", base, -1), "/", 1).alias("archive"),
        member("path").alias("member"),
        "length",
        "content",
    )


def member_name(member: Column) -> Column:
    """The fourth part of a member path."""
    return F.get(F.split(member, "/"), F.lit(3))


def thumbnails(
    files: DataFrame, platform: str = BOARD_PLATFORM, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Catalogue rows: the fourth part of the member path is the name, its digits the id.

    The id is a time in epoch milliseconds, so a date range applies to it directly. Members
    without a fourth part or without digits in it are left out.
    """
    name = member_name(F.col("member"))
    board = F.concat(F.lit("/"), F.substring_index("archive", "_", 1), F.lit("/"))
    catalogue = files.select(
        F.lit(platform).alias("platform"),
        board.alias("board"),
        fields.digits(name).alias("image_id"),
        name.alias("thumb_name"),
        F.col("length").alias("thumb_size"),
        F.col("content").alias("data"),
    ).where(F.col("image_id").isNotNull())
    return catalogue.where(images_within(start, end))


def images_within(start: str | None, end: str | None):
    return fields.within(F.floor(F.col("image_id") / 1000), start, end)


def image_rows(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("platform", "board", "image_id", "thumb_name", "thumb_size")


def thumb_rows(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("platform", "board", "image_id", "data")
