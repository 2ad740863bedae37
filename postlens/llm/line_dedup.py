"""Line dedup with range-partitioned hashes and compressed keep bitmaps.

Long lines that many documents share stay in the largest document that holds them only. Keys of
lines travel as 128-bit hashes with document and position. A first aggregation with map-side
combine finds the hashes that would weigh on one task (a bounded number, by the threshold); those
are settled from their counts. All others are range-partitioned by hash with a secondary sort by
document and position, so the first row of each run is the holder that stays, and one pass over
the run gives the number of its documents. The result is a bitmap per document of which only
64-line words with a dropped line are kept; texts are touched again only where a line is dropped.

A document is a row. A null or empty text is one empty line. A null doc_id ranks below all
others. Rows with equal doc_id and text get the same bitmap. Lines of the largest document all
stay, repeated ones too. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.sources.layout import settled

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
# A hash is hot if it has more than this share of all occurrences; so at most 2,000 are.
HOT_SHARE = 1 / 2000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """h1, h2, doc_id, body, pos of every line whose key is long enough."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_length).withColumn(
        "key", F.expr("translate(trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM line), "
                      f"'{UPPER}', '{LOWER}')")).where(F.length("key") >= min_length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                        "doc_id", "body", "pos")


def dropped_lines(docs: DataFrame, min_length: int = MIN_LENGTH,
                  min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, body, pos of every line that goes."""
    found = settled(occurrences(docs, min_length))
    line, holder = ["h1", "h2"], F.struct("doc_id", "body")
    weights = found.groupBy(*line).agg(F.count("*").alias("weight"))
    hot = weights.where(F.col("weight") > max(int(found.count() * HOT_SHARE), 1000))
    held = found.join(F.broadcast(hot), line).select(*line, "doc_id", "body").distinct()
    hot = settled(held.groupBy(*line).agg(
        F.count("*").alias("holders"), F.max("doc_id").alias("top")))

    marked = found.join(F.broadcast(hot), line, "left")
    settled_hot = marked.where(
        (F.col("holders") >= min_documents) & ~F.col("doc_id").eqNullSafe(F.col("top")))
    cold = marked.where(F.col("holders").isNull()).repartitionByRange(*line)
    run = Window.partitionBy(*line).orderBy(F.col("doc_id").desc_nulls_last(), "body", "pos")
    whole = Window.partitionBy(*line).orderBy(
        F.col("doc_id").desc_nulls_last(), "body", "pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    streamed = (
        cold.withColumn("first", F.first("doc_id").over(whole))
        .withColumn("starts", ~F.lag(holder).over(run).eqNullSafe(holder))
        .withColumn("documents", F.sum(F.col("starts").cast("int")).over(whole)))
    settled_cold = streamed.where(
        (F.col("documents") >= min_documents) & ~F.col("doc_id").eqNullSafe(F.col("first")))
    where = ["doc_id", "body", "pos"]
    return settled_hot.select(where).unionByName(settled_cold.select(where))


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH,
                 min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, body (hash of the text), gone: array of (word, bits), a set bit is a dropped line.

    Only documents that lose a line appear, and only words of 64 lines that have one.
    """
    gone = dropped_lines(docs, min_length, min_documents)
    words = gone.groupBy("doc_id", "body", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with ``text`` reduced to its kept lines, and n_lines, n_dropped."""
    marks = bitmaps.select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body"),
        F.map_from_entries("gone").alias("_gone"))
    joined = docs.withColumn("_key", F.xxhash64("text")).join(
        marks, (F.col("_key") == F.col("_body"))
        & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    kept = F.expr(
        "array_join(filter(split(text, '\\n', -1), (l, i) -> "
        "(shiftright(coalesce(element_at(_gone, i div 64), 0L), i % 64) & 1) = 0), '\\n')")
    return joined.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text")
          if c == "text" else F.col(c) for c in docs.columns],
        (F.length(F.coalesce("text", F.lit(""))) - F.length(
            F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1)
        .cast("long").alias("n_lines"),
        F.expr("coalesce(aggregate(map_values(_gone), 0L, (a, b) -> a + bit_count(b)), 0L)")
        .alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH,
                min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_length, min_documents))
