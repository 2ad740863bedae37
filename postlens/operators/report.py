"""The marker report: how often each marker occurs in three scopes, and the matching posts.

Scopes: ``all`` posts of the marker's platform, ``qanon`` the reference dataset of that
platform, ``sample`` the sampled posts of the platform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.fields import share_text
from postlens.operators.matching import hits, marked_up
from postlens.operators.ranking import ranked_hits
from postlens.schema import CLOSE_TAG, MATCH_VIEW, OPEN_TAG, REFERENCE_PREFIX
from postlens.sources.layout import broadcast_if_small, settled
from postlens.sources.markers import Markers

SCOPES = ["all", "qanon", "sample"]
MARKER_COLUMNS = [
    "index", "platform", "category", "type", "marker_title", "marker_group", "fts_query",
    "to_analyse",
]
# Length that a list of post ids is split at; the parts of one list are separate rows.
LIST_LENGTH = 10_000
DRILL_COLUMNS = ["post_id", "timestamp", "author", "platform", "board", "rank", "body"]


def scope_flags() -> dict[str, Column]:
    own = F.col("platform") == F.col("marker_platform")
    return {
        "all": own,
        "qanon": F.col("platform") == F.concat(F.lit(REFERENCE_PREFIX), "marker_platform"),
        "sample": own & F.col("in_sample"),
    }


def measure_columns() -> list[str]:
    counts = [c for s in SCOPES for c in (f"count_{s}", f"count_{s}_rel")]
    return counts + [c for s in SCOPES for c in (f"match_{s}", f"match_{s}_ratio")]


def scoped_hits(posts: DataFrame, markers: Markers) -> DataFrame:
    """(index, uid, spans, in_all, in_qanon, in_sample) from ``posts(..., in_sample)``."""
    found = hits(posts, markers, ["platform", "in_sample"], scoped=True)
    return found.select(
        F.col("marker").alias("index"), "uid", "spans",
        *[flag.alias(f"in_{scope}") for scope, flag in scope_flags().items()])


def marker_counts(found: DataFrame) -> DataFrame:
    """Matched posts and spans per marker and scope, from scoped hits or stored hit rows."""
    measures = []
    for scope in SCOPES:
        flag = F.col(f"in_{scope}")
        measures += [
            F.count_if(flag).alias(f"count_{scope}"),
            F.sum(F.when(flag, F.col("spans")).otherwise(0)).alias(f"match_{scope}"),
        ]
    return found.groupBy("index").agg(*measures)


def marker_report(
    markers: Markers, counted: DataFrame, totals: DataFrame, sample_sizes: DataFrame
) -> DataFrame:
    """One row per marker to analyse; a marker that cannot be evaluated has -1 everywhere."""
    reference = totals.select(
        F.col("platform").alias("reference"), F.col("count_posts").alias("total_qanon"))
    measured = (
        markers.rows
        .join(counted.withColumnRenamed("index", "marker"),
              F.col("problem").isNull() & (F.col("index") == F.col("marker")), "left")
        .join(totals.withColumnRenamed("count_posts", "total_all"), "platform", "left")
        .join(reference, F.concat(F.lit(REFERENCE_PREFIX), "platform") == F.col("reference"), "left")
        .join(sample_sizes.withColumnRenamed("sample_size", "total_sample"), "platform", "left")
    )
    valid = F.col("problem").isNull()
    columns = {}
    for scope in SCOPES:
        count = F.coalesce(f"count_{scope}", F.lit(0)).cast("bigint")
        spans = F.coalesce(f"match_{scope}", F.lit(0)).cast("bigint")
        columns[f"count_{scope}"] = F.when(valid, count).otherwise(-1)
        columns[f"count_{scope}_rel"] = F.when(
            valid, share_text(count, F.col(f"total_{scope}"))).otherwise(F.lit("-1"))
        columns[f"match_{scope}"] = F.when(valid, spans).otherwise(-1)
        columns[f"match_{scope}_ratio"] = F.when(
            valid & (count > 0), spans / count).otherwise(F.lit(-1.0))
    return measured.select(
        *MARKER_COLUMNS, *[columns[name].alias(name) for name in measure_columns()]
    )


def post_hits(found: DataFrame, markers: DataFrame) -> DataFrame:
    """(uid, hits): one row per matched post with all its markers, from scoped hits or hit rows.

    A hit carries the groups and scopes it counts for. Counts, lists and distinct posts of any grouping
    of the markers come from this table alone: what belongs to a post is in its row, so no ids are
    shuffled to find out which posts are distinct. Tables of several loads are put together by union.
    """
    groups = markers.select(
        F.col("index").alias("_index"), F.col("platform").alias("_platform"), "category", "marker_group")
    named = found.select("index", "uid", "spans", *[f"in_{s}" for s in SCOPES]).join(
        broadcast_if_small(groups), F.col("index") == F.col("_index"))
    hit = F.struct(
        "index", F.col("_platform").alias("platform"), "category", "marker_group", "spans",
        *[f"in_{s}" for s in SCOPES])
    return named.groupBy("uid").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def scoped_counts(posts: DataFrame) -> DataFrame:
    """``marker_counts`` from ``post_hits``."""
    return marker_counts(posts.select(F.inline("hits")))


def hit_uids(posts: DataFrame) -> DataFrame:
    """(index, scope, uid), one row per matched post and scope, from ``post_hits``."""
    scopes = F.array_compact(F.array(*[F.when(F.col(f"in_{s}"), F.lit(s)) for s in SCOPES]))
    return posts.select("uid", F.inline("hits")).select("index", F.explode(scopes).alias("scope"), "uid")


def uid_lists(uids: DataFrame, length: int = LIST_LENGTH) -> DataFrame:
    """(index, scope, part, uids): the id lists in parts of about ``length`` ids.

    A marker may match a third of all posts, so its list is never brought together: the number
    of parts follows the size of the list and a hash of the id chooses the part.
    """
    parts = settled(uids.groupBy("index", "scope").agg(
        F.ceil(F.count("*") / length).cast("bigint").alias("parts")))
    spread = F.conv(F.substring(F.md5(F.col("uid").cast("string")), 1, 8), 16, 10).cast("bigint")
    return (
        uids.join(broadcast_if_small(parts), ["index", "scope"])
        .groupBy("index", "scope", (spread % F.col("parts")).alias("part"))
        .agg(F.sort_array(F.collect_list("uid")).alias("uids"))
    )


def hit_rows(
    posts: DataFrame, markers: Markers, corpus: tuple[float, float] | None = None
) -> DataFrame:
    """Matching posts of the marker's platform and its reference dataset, with rank and tags.

    ``in_all``, ``in_qanon`` and ``in_sample`` tell the scopes a row belongs to.
    """
    kept = [c for c in MATCH_VIEW if c not in ("uid", "rank")]
    found = ranked_hits(posts, markers, [*kept, "in_sample"], with_ends=True, scoped=True, corpus=corpus)
    flags = scope_flags()
    marked = marked_up("body", "result.spans", OPEN_TAG, CLOSE_TAG)
    return found.select(
        F.col("marker").alias("index"),
        *[marked.alias("body") if c == "body" else F.col(c) for c in MATCH_VIEW],
        *[flags[s].alias(f"in_{s}") for s in SCOPES],
        "spans",
    )


def drilldown(rows: DataFrame, index: str, scope: str | None = None) -> DataFrame:
    """Hit rows of one marker, of one scope or of all, in the seven columns shown.

    On a stored table the marker is a partition, so only its files are read.
    """
    chosen = rows.where(F.col("index") == index)
    if scope is not None:
        chosen = chosen.where(F.col(f"in_{scope}"))
    return chosen.select(*DRILL_COLUMNS)
