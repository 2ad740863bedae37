"""Column lists, key lists and Spark schemas shared by the jobs."""

from __future__ import annotations

# The eleven columns every post source is shaped into, in insert order.
POST_COLUMNS = [
    "platform", "board", "post_type", "post_id", "timestamp",
    "thread_id", "parent_id", "author", "subject", "body", "extras",
]
POST_KEY = ["platform", "board", "post_type", "post_id", "timestamp"]
IMAGE_KEY = ["platform", "board", "image_id"]
ARCHIVE_KEY = ["platform", "board", "group1"]

# Narrow and wide views over posts, in output order.
META_VIEW = [
    "uid", "post_id", "timestamp", "thread_id", "thread_uid", "parent_id",
    "parent_uid", "author", "board", "platform", "post_type",
]
FULL_VIEW = META_VIEW[:8] + ["subject", "body", "extras"] + META_VIEW[8:]
MATCH_VIEW = META_VIEW + ["rank", "subject", "extras", "body"]

# Prefix that names the reference dataset of a platform.
REFERENCE_PREFIX = "q_"

# Rows of the platform dimension (uid, name, archive) and of the type dimension.
BOARD_PLATFORM = "4chan"
FORUM_PLATFORM = "reddit"
PLATFORMS = [
    (1, BOARD_PLATFORM, "4plebs"),
    (2, FORUM_PLATFORM, "redarcs"),
    (3, REFERENCE_PREFIX + BOARD_PLATFORM, "hagen-et-al"),
    (4, REFERENCE_PREFIX + FORUM_PLATFORM, "hagen-et-al"),
]
POST_TYPES = [(1, "thread"), (2, "comment"), (3, "submission")]

# The tags put around a hit.
OPEN_TAG = '<span class="fts_match">'
CLOSE_TAG = "</span>"

MARKER_SCHEMA = """
    index string, platform string, category string, type string,
    marker_title string, marker_group string, fts_query string, to_analyse int,
    clauses array<struct<negated: boolean,
        atoms: array<struct<kind: string, tokens: array<string>, k: int>>>>
"""
