"""Import jobs: source files into the posts table and the image tables."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import counts, dedupe, dimensions, statistics
from postlens.operators.matching import with_length
from postlens.operators.uid_index import BUCKETS, UidIndex, known_keys
from postlens.schema import ARCHIVE_KEY, FULL_VIEW, IMAGE_KEY, POST_KEY
from postlens.sources import images, posts as sources
from postlens.sources.layout import broadcast_if_small, settled, together
from postlens.sources.selection import list_files, select_files
from postlens.session import pin_utc
from postlens.sinks import tables


def read_sources(
    spark: SparkSession, folders: dict[str, str], skip: list[str] | None = None,
    exclude: list[str] | None = None, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """All chosen files as one shaped frame; the file list is the only thing on the driver."""
    chosen = select_files(list_files(spark, folders), skip, exclude)
    groups: dict[tuple[int, str], list[str]] = {}
    for row in chosen.select("source_rank", "kind", "path").collect():
        groups.setdefault((row.source_rank, row.kind), []).append(row.path)
    if not groups:
        raise ValueError("no input files are left after skipping and excluding")
    parts = [
        sources.read_posts(spark, kind, sorted(paths), start, end)
        .withColumn("source_rank", F.lit(rank))
        for (rank, kind), paths in sorted(groups.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def load_posts(
    spark: SparkSession, folders: dict[str, str], out: str, load_id: str,
    skip: list[str] | None = None, exclude: list[str] | None = None,
    start: str | None = None, end: str | None = None, index_buckets: int = BUCKETS,
) -> None:
    """Load source files into ``<out>/posts``; repeating a load adds nothing.

    Compressed files are one task each, so all files are parsed once into a staged table.
    Everything after that reads splittable columnar files. What is stored already is known from
    the index in ``<out>/index``; ``index_buckets`` must not change between loads.
    """
    pin_utc(spark)
    staged_path, table = f"{out}/staged/{load_id}", f"{out}/posts"
    now = datetime.now(timezone.utc)
    refresh_statistics(spark, out)
    read_sources(spark, folders, skip, exclude, start, end).write.mode("overwrite").parquet(staged_path)
    staged = spark.read.parquet(staged_path)
    good = sources.accepted(staged)

    batch = dedupe.first_wins_stored(good, POST_KEY, ["source_rank", "source_file"])
    # Keys and hashes only; the texts are read once more, for the table itself.
    keys = settled(dedupe.key_hashes(batch))
    index = UidIndex(spark, f"{out}/index", index_buckets)
    again = tables.exists(spark, table)
    if again and index.is_empty():  # a table from before the index
        index.add(tables.stored_posts(spark, table).select("uid"))
    used = index.used(keys)
    if again:
        known = known_keys(keys, used, tables.stored_posts(spark, table), POST_KEY)
        if not known.isEmpty():
            batch = batch.join(broadcast_if_small(known), POST_KEY, "left_anti")
            keys = settled(keys.join(broadcast_if_small(known), POST_KEY, "left_anti"))
    slots = dedupe.shared_slots(keys, used=used)

    # The ids are listed before the posts are stored: a load that breaks off can be run again.
    together(
        lambda: index.add(settled(dedupe.with_slots(keys, slots).select("uid"))),
        lambda: sources.rejected(staged).write.mode("overwrite").parquet(f"{out}/quarantine/{load_id}"),
        lambda: _extend_boards(spark, good, f"{out}/boards"),
        # The other two dimensions are fixed rows.
        lambda: dimensions.platforms(spark).write.mode("overwrite").parquet(f"{out}/platforms"),
        lambda: dimensions.post_types(spark).write.mode("overwrite").parquet(f"{out}/types"),
        lambda: counts.load_summary(good).write.mode("overwrite").json(f"{out}/load_summary/{load_id}"),
    )
    fresh = (
        dedupe.with_slots(batch, slots)
        .withColumn("thread_uid", F.lit(None).cast("bigint"))
        .withColumn("parent_uid", F.lit(None).cast("bigint"))
        .withColumn("added", F.lit(now))
    )
    # The length in tokens is stored, so that corpus statistics need no texts. The tokens are
    # not, which keeps the table and its shuffle small: a match cuts the text again.
    columns = [*FULL_VIEW, "added", "source_file", "dl"]
    tables.store_posts(with_length(fresh).select(*columns), table)
    if tables.exists(spark, table):
        own = tables.stored_posts(spark, table).where(F.col("added") == F.lit(now))
        _store_statistics(spark, own, out, load_id)


def _store_statistics(spark: SparkSession, posts: DataFrame, out: str, load_id: str) -> None:
    partial = statistics.partial(posts.select("platform", "board", "timestamp", "dl"))
    tables.write_partitioned(partial.withColumn("load_id", F.lit(load_id)), f"{out}/statistics", ["load_id"], "append")


def refresh_statistics(spark: SparkSession, out: str) -> None:
    """Count what a load that broke off behind its posts did not count.

    The number of stored posts is in the footers of their files. If the statistics do not add up to
    it, the loads are told apart by their time and the whole table is counted again, from four columns.
    """
    if not tables.exists(spark, f"{out}/posts"):
        return
    posts = tables.stored_posts(spark, f"{out}/posts")
    counted = 0
    if tables.exists(spark, f"{out}/statistics"):
        stored = tables.stored_statistics(spark, f"{out}/statistics")
        counted = stored.agg(F.coalesce(F.sum("posts"), F.lit(0))).first()[0]
    if counted != posts.count():
        partial = statistics.partial(posts.select("platform", "board", "timestamp", "dl"))
        tables.write_partitioned(
            settled(partial).withColumn("load_id", F.lit("all")), f"{out}/statistics", ["load_id"], "overwrite")


def _extend_boards(spark: SparkSession, posts: DataFrame, path: str) -> None:
    """Add the boards of a load, first seen or seen again after a load that broke off."""
    names = posts.select(F.col("board").alias("name")).distinct()
    if tables.exists(spark, path):
        known = spark.read.schema("uid long, name string").parquet(path)
    else:
        known = spark.createDataFrame([], "uid long, name string")
    dimensions.new_names(known, names).write.mode("append").parquet(path)


def load_images(
    spark: SparkSession, out: str, manifests: str | list[str] | None = None,
    thumbnail_root: str | None = None, url_prefix: str = "",
    start: str | None = None, end: str | None = None,
) -> None:
    """Archive manifests and expanded thumbnails into ``images``, ``thumbs`` and ``archives``."""
    pin_utc(spark)
    if manifests is not None:
        entries = images.archive_entries(images.read_manifests(spark, manifests), url_prefix)
        _append_new(spark, entries, f"{out}/archives", ARCHIVE_KEY)
    if thumbnail_root is not None:
        found = images.thumbnails(
            images.read_thumbnail_files(spark, thumbnail_root, start, end), start=start, end=end)
        catalogue = (
            images.image_rows(found)
            .withColumn("image_name", F.lit(None).cast("string"))
            .withColumn("image_size", F.lit(None).cast("bigint"))
            .withColumn("added", F.current_timestamp())
            .withColumn("updated", F.lit(None).cast("timestamp"))
        )
        _append_new(spark, catalogue, f"{out}/images", IMAGE_KEY)
        _append_new(spark, images.thumb_rows(found), f"{out}/thumbs", IMAGE_KEY)


def _append_new(spark: SparkSession, rows: DataFrame, path: str, key: list[str]) -> None:
    # Counting keys reads no image bytes; unique images are never shuffled.
    batch = dedupe.first_wins_stored(rows, key)
    if tables.exists(spark, path):
        batch = dedupe.not_stored(batch, spark.read.parquet(path), key)
    batch.write.mode("append").parquet(path)
