"""Exact ranks over data of any size without one sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*columns: Column) -> Column:
    """Reproducible 128-bit key, as text, that spreads rows evenly."""
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def number_rows(
    rows: DataFrame, key: str, order: list[str], within: list[str], name: str, digits: int = 2
) -> DataFrame:
    """``row_number`` over (key, order) inside each ``within`` group, spread over hash buckets.

    ``key`` is a column made by ``hash_key``. Its leading hex digits form buckets that sort
    like the key, so a global rank is the number of rows in earlier buckets plus the rank
    inside the bucket. Only bucket sizes (16 ** digits per group) meet in one place.
    """
    bucketed = rows.withColumn("_bucket", F.substring(key, 1, digits))
    groups = [*within, "_bucket"]
    earlier = (
        Window.partitionBy(*within).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*groups).agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*groups).orderBy(key, *order)
    ranked = bucketed.withColumn("_inside", F.row_number().over(inside))
    return (
        ranked.join(offsets, groups)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )
