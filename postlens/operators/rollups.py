"""Rollups of the marker report and the scaling behind its colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.report import SCOPES


def _sums() -> list[Column]:
    """Sums that leave out the sentinel -1; shares are added as ten-decimal numbers."""
    def total(name: str) -> Column:
        value = F.col(name)
        return F.coalesce(F.sum(F.when(value != -1, value)), F.lit(0)).cast("bigint").alias(name)

    def share(name: str) -> Column:
        value = F.col(name).cast("double")
        added = F.coalesce(F.sum(F.when(value != -1, value)), F.lit(0.0))
        return F.format_string("%.10f", added).alias(name)

    return (
        [total(f"count_{s}") for s in SCOPES]
        + [share(f"count_{s}_rel") for s in SCOPES]
        + [total(f"match_{s}") for s in SCOPES]
    )


def by_category(report: DataFrame) -> DataFrame:
    """A post with several markers counts several times."""
    return report.groupBy("platform", "category").agg(
        F.min_by("type", "index").alias("type"), *_sums())


def by_group(report: DataFrame) -> DataFrame:
    return report.groupBy("platform", "marker_group").agg(
        F.min_by("category", "index").alias("category"),
        F.min_by("type", "index").alias("type"), *_sums())


def once_per_post(posts: DataFrame, markers: DataFrame, level: str) -> DataFrame:
    """Distinct posts per platform, ``level`` (category or marker_group) and scope, from ``post_hits``.

    A post's groups are made distinct inside its row, so only counts are shuffled. Groups whose
    markers have no hits are there with zeros.
    """
    groups = ["platform", level]
    asked = markers.where("to_analyse = 1").select(*groups).distinct()
    scopes = ", ".join(f"if(h.in_{s}, '{s}', null)" for s in SCOPES)
    own = f"""array_distinct(flatten(transform(hits, h -> transform(array_compact(array({scopes})),
        scope -> struct(h.platform as platform, h.{level} as {level}, scope as scope)))))"""
    counted = posts.selectExpr(f"inline({own})").groupBy(*groups).agg(
        *[F.count_if(F.col("scope") == s).alias(f"count_{s}") for s in SCOPES])
    return asked.join(counted, groups, "left").na.fill(0)


def heat_scale(report: DataFrame) -> DataFrame:
    """Every share and ratio with its place between the smallest and largest of its kind.

    Reads the report twice, so pass a stored one.
    """
    columns = [f"count_{s}_rel" for s in SCOPES] + [f"match_{s}_ratio" for s in SCOPES]
    numbers = report.select("index", *[F.col(c).cast("double").alias(c) for c in columns])
    values = (
        numbers.unpivot("index", columns, "measure", "value")
        .where(F.col("value") != -1)
        .withColumn("kind", F.when(F.col("measure").endswith("_rel"), "rel").otherwise("ratio"))
    )
    # Two rows, one per kind.
    bounds = values.groupBy("kind").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))
    return values.join(F.broadcast(bounds), "kind").select(
        "index", "measure", "kind", "value", F.sqrt(place).alias("scaled"))
