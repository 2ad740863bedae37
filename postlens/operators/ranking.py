"""Relevance of a match: negative BM25 over the phrases of a marker, smaller is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.sql import upto
from postlens.operators.matching import in_scope, match, with_length
from postlens.sources.layout import settled, stored
from postlens.sources.markers import Markers

# Fixed values of the ranking formula.
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6


def phrase_weights(
    posts: DataFrame, matched: DataFrame, corpus: tuple[float, float] | None = None
) -> DataFrame:
    """(marker, weights, mean_length): inverse document frequencies over all posts.

    ``matched(marker, seen)`` tells which phrases each candidate post holds. The corpus counts
    every post of every platform, also those without a body. What comes out of the shuffle is one
    row per phrase. ``corpus`` (posts, mean length), if it is known, saves reading the posts for it.
    """
    if corpus is None:
        whole = with_length(posts).agg(F.struct(
            F.count("*").cast("double").alias("n"), F.avg("dl").alias("length"))).scalar()
        total, mean_length = whole["n"], whole["length"]
    else:
        total, mean_length = F.lit(corpus[0]), F.lit(corpus[1])
    frequency = (
        matched.select("marker", F.posexplode("seen").alias("phrase", "seen"))
        .where("seen")
        .groupBy("marker", "phrase").agg(F.count("*").alias("posts"))
    )
    idf = F.log((total - F.col("posts") + 0.5) / (F.col("posts") + 0.5))
    return (
        frequency.withColumn("idf", idf)
        .withColumn("idf", F.when(F.col("idf") > 0, F.col("idf")).otherwise(F.lit(LEAST_IDF)))
        .groupBy("marker")
        .agg(F.map_from_entries(F.collect_list(F.struct("phrase", "idf"))).alias("weights"))
        .withColumn("mean_length", mean_length)
    )


# Sum over the phrases of weight * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean length)).
_SCORE = f"""aggregate({upto(0, 'size(result.f) - 1')}, 0D, (total, no) -> total
    + coalesce(element_at(weights, no), 0D) * ((get(result.f, no) * ({K1}D + 1))
        / (get(result.f, no) + {K1}D * (1 - {B}D + {B}D * (dl / mean_length)))))"""


def rank() -> Column:
    return F.expr(f"round({_SCORE} * -1, 3)")


def ranked_hits(
    posts: DataFrame, markers: Markers, keep: list[str],
    with_ends: bool = False, scoped: bool = False, corpus: tuple[float, float] | None = None,
) -> DataFrame:
    """Hits with their ``rank``, from one pass over the texts.

    Frequencies count posts of all platforms, so all candidates are matched and stored, but
    only those that hold in their scope carry the columns of the post.
    """
    carried = list(dict.fromkeys([*keep, "dl", *(["platform"] if scoped else [])]))
    found = match(posts, markers, carried, with_ends)
    holds = F.col("result.holds") & in_scope() if scoped else F.col("result.holds")
    table = stored(found.withColumn("holds", holds).select(
        "marker", "marker_platform", "uid", "holds", F.col("result.seen").alias("seen"),
        *[F.when(F.col("holds"), F.col(c)).alias(c) for c in carried],
        F.when(F.col("holds"), F.struct("result.f", "result.spans")).alias("result")))
    weights = settled(phrase_weights(posts, table, corpus))
    if markers.small:  # one row per marker, and their number was checked
        weights = F.broadcast(weights)
    hit = table.where("holds").withColumn("spans", F.size("result.spans.starts"))
    return hit.join(weights, "marker").withColumn("rank", rank()).drop(
        "weights", "mean_length", "holds", "seen")
