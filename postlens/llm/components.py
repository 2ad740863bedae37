"""Connected components of an edge table, by alternating large and small stars.

Every step is an aggregation with map-side combine and an equi-join, so a node with very many
neighbours is never gathered in one task. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.sources.layout import settled


def _hooked(edges: DataFrame) -> DataFrame:
    """Large star: each larger neighbour of a node moves to the least one."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b")


def _folded(edges: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node that has an edge.

    ``edges`` has two long columns a and b; loops and repeated edges do no harm.
    """
    def state(rows: DataFrame):
        return rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = settled(edges.toDF("a", "b").where("a <> b"))
    before = None
    while True:
        edges = settled(_folded(_hooked(edges)))
        now = state(edges)
        if now == before:
            break
        before = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return settled(labels.union(roots).distinct())
