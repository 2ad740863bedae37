"""Readers for the five post sources and their mapping to the common post columns.

Every source has a reader (files to raw string columns) and a shaper (raw columns to
``POST_COLUMNS`` plus ``defects`` and, for defective records only, ``raw``). ``accepted`` and
``rejected`` split a shaped frame, so one bad record never costs more than itself and can be
repaired from the rejected rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import fields
from postlens.schema import BOARD_PLATFORM, FORUM_PLATFORM, POST_COLUMNS, REFERENCE_PREFIX
from postlens.sources.records import read_split_csv

RESEARCH_BOARD_RAW = (
    "thread_id string, post_id string, author string, subject string, body string, epoch string"
)
RESEARCH_FORUM_RAW = (
    "post_id string, parent_id string, subreddit string, body string, epoch string"
)
# ``media`` can be any JSON value; the epoch may be quoted and have a fraction.
SUBMISSION_RAW = (
    "subreddit string, id string, created_utc string, parent_id string, author string, "
    "title string, media variant, thumbnail string, url string, _corrupt_record string"
)
COMMENT_RAW = (
    "subreddit string, id string, created_utc string, link_id string, parent_id string, "
    "author string, body string, _corrupt_record string"
)
BOARD_DUMP_RAW = ", ".join(f"c{i} string" for i in range(23))

# A quoted empty field is an empty text, only an absent one is null.
_CSV = {"quote": '"', "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE"}
QUOTED_CSV = {**_CSV, "escape": '"'}
ESCAPED_CSV = {**_CSV, "escape": "\\"}
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy", ".deflate")
JSON_LINES = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


# --- readers -------------------------------------------------------------------------


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: str, options: dict, header: bool = False
) -> DataFrame:
    """Records may span lines. A plain file is read by a task per split, a compressed one by one task.

    A header is the first record of a file, whatever it says. The file list is on the driver.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path", "length").collect()
    plain = [(f.path, f.length) for f in listed if not f.path.endswith(COMPRESSED)]
    packed = [f.path for f in listed if f.path.endswith(COMPRESSED)]
    parts = [read_whole_csv(spark, packed, schema, options, header)] if packed or not plain else []
    if plain:
        parts.append(read_split_csv(spark, plain, schema, options, header))
    return reduce(DataFrame.unionByName, parts)


def read_whole_csv(
    spark: SparkSession, paths: str | list[str], schema: str, options: dict, header: bool = False
) -> DataFrame:
    """A file is one task: spread the rows before heavy work."""
    raw = spark.read.schema(schema).options(**options).option("multiLine", True).csv(paths, header=header)
    return raw.withColumn("source_file", F.col("_metadata.file_path"))


def read_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    raw = spark.read.schema(schema).options(**JSON_LINES).json(paths)
    return raw.withColumn("source_file", F.col("_metadata.file_path"))


def read_posts(
    spark: SparkSession, kind: str, paths: str | list[str],
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Shaped posts of one source kind, see ``KINDS``."""
    return KINDS[kind](spark, paths).transform(lambda posts: in_range(posts, start, end))


def in_range(posts: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is None and end is None:
        return posts
    # Rows without a readable time stay, so that they reach the rejected rows.
    return posts.where(
        F.col("timestamp").isNull() | fields.within(F.unix_seconds("timestamp"), start, end)
    )


# --- shapers -------------------------------------------------------------------------


def _shaped(raw: DataFrame, required: list[str], **columns: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    values = {name: columns.get(name, nothing) for name in POST_COLUMNS if name != "timestamp"}
    values["timestamp"] = F.timestamp_seconds(columns["epoch"])
    source = F.col("source_file") if "source_file" in raw.columns else nothing
    # What a rejected record looked like: its text where the reader kept it, else its fields.
    record = F.to_json(F.struct(*[c for c in raw.columns if c not in ("source_file", "_corrupt_record")]))
    if "_corrupt_record" in raw.columns:
        record = F.coalesce("_corrupt_record", record)
    shaped = raw.select(
        *[values[name].alias(name) for name in POST_COLUMNS], source.alias("source_file"),
        record.alias("raw"),
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    return shaped.withColumn("defects", missing).withColumn(
        "raw", F.when(F.size("defects") > 0, F.col("raw")))


_KEY_FIELDS = ["board", "post_id", "timestamp"]


def research_board_posts(raw: DataFrame, platform: str = REFERENCE_PREFIX + BOARD_PLATFORM) -> DataFrame:
    """Research dataset of an imageboard: one board, parent taken from the leading quote."""
    empty = F.lit("")
    body = F.coalesce("body", empty)
    return _shaped(
        raw,
        _KEY_FIELDS,
        platform=F.lit(platform), board=F.lit("/pol/"), post_type=F.lit("comment"),
        post_id=F.col("post_id"), epoch=fields.epoch_seconds(F.col("epoch")),
        thread_id=F.col("thread_id"), parent_id=fields.parent_from_quote(body),
        author=F.coalesce("author", empty), subject=F.coalesce("subject", empty), body=body,
    )


def research_forum_posts(raw: DataFrame, platform: str = REFERENCE_PREFIX + FORUM_PLATFORM) -> DataFrame:
    """Research dataset of a link forum: one row per comment, no thread and no author."""
    return _shaped(
        raw,
        _KEY_FIELDS,
        platform=F.lit(platform), board=F.concat(F.lit("r/"), "subreddit"),
        post_type=F.lit("comment"), post_id=F.col("post_id"),
        epoch=fields.epoch_seconds(F.col("epoch")),
        parent_id=F.coalesce("parent_id", F.lit("")), body=F.coalesce("body", F.lit("")),
    )


def submission_posts(raw: DataFrame, platform: str = FORUM_PLATFORM) -> DataFrame:
    """Submissions: title as subject, no body, media fields packed into ``extras``."""
    extras = F.to_json(F.struct("media", "thumbnail", "url"), {"ignoreNullFields": "false"})
    return _shaped(
        raw,
        _KEY_FIELDS,
        platform=F.lit(platform), board=F.concat(F.lit("r/"), "subreddit"),
        post_type=F.lit("submission"), post_id=F.col("id"),
        epoch=fields.number_seconds(F.col("created_utc")),
        parent_id=F.col("parent_id"), author=F.col("author"), subject=F.col("title"),
        extras=extras,
    )


def comment_posts(raw: DataFrame, platform: str = FORUM_PLATFORM) -> DataFrame:
    return _shaped(
        raw,
        _KEY_FIELDS,
        platform=F.lit(platform), board=F.concat(F.lit("r/"), "subreddit"),
        post_type=F.lit("comment"), post_id=F.col("id"),
        epoch=fields.number_seconds(F.col("created_utc")),
        thread_id=F.col("link_id"), parent_id=F.col("parent_id"), author=F.col("author"),
        body=F.col("body"),
    )


def board_dump_posts(raw: DataFrame, platform: str = BOARD_PLATFORM) -> DataFrame:
    """Imageboard dump, columns by position, board from the file name.

    A backslash at a line end only protects the line break. Lines that are no record (text
    torn off a record) have no numeric post id or no body and count as defective.
    """
    body = F.regexp_replace("c22", r"\\(\r?\n)", "$1")
    thumbnail = fields.null_marker(F.nullif("c14", F.lit("")))
    return _shaped(
        raw,
        [*_KEY_FIELDS, "body"],
        platform=F.lit(platform), board=fields.board_from_path(F.col("source_file")),
        post_type=F.lit("comment"),
        post_id=F.when(F.col("c0").rlike("^[0-9]+$"), F.col("c0")),
        epoch=fields.epoch_seconds(F.col("c4")),
        thread_id=F.col("c2"), parent_id=fields.parent_from_quote(body),
        author=F.col("c19"), subject=F.col("c21"), body=body,
        extras=F.when(thumbnail.isNotNull(), F.to_json(F.struct(thumbnail.alias("thumbnail")))),
    )


def accepted(shaped: DataFrame) -> DataFrame:
    return shaped.where(F.size("defects") == 0).drop("defects", "raw")


def rejected(shaped: DataFrame) -> DataFrame:
    return shaped.where(F.size("defects") > 0)


KINDS = {
    "research_board": lambda spark, paths: research_board_posts(
        read_csv(spark, paths, RESEARCH_BOARD_RAW, QUOTED_CSV, header=True)),
    "research_forum": lambda spark, paths: research_forum_posts(
        read_csv(spark, paths, RESEARCH_FORUM_RAW, QUOTED_CSV, header=True)),
    "submissions": lambda spark, paths: submission_posts(read_json(spark, paths, SUBMISSION_RAW)),
    "comments": lambda spark, paths: comment_posts(read_json(spark, paths, COMMENT_RAW)),
    "board_dump": lambda spark, paths: board_dump_posts(
        read_csv(spark, paths, BOARD_DUMP_RAW, ESCAPED_CSV)),
}
