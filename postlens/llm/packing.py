"""Best-fit packing of documents into sequences of several permitted lengths.

Documents of equal length are interchangeable, so the packing works on the histogram of lengths,
which has at most as many rows as the largest sequence has words, however many documents there
are. Best-fit decreasing runs over it in bulk: many bins with the same free space take items
together. A new bin gets the permitted length with the least cost per word it is expected to hold,
given the shorter items still to come; at the end each bin shrinks to the least permitted length
that holds its contents. Each document finds its bin by its rank among those of its length; ranks
of frequent lengths are counted in salted parts.

Texts longer than the largest sequence become several pieces, none is cut off. Null, empty and
blank texts have no words and get a row without a bin. Repeated rows are counted first and each
gets a place. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.sources.layout import settled

SEQUENCE_LENGTHS = (512, 1024, 2048, 4096, 8192)
# Cost of a sequence in word units: fixed, linear and quadratic (attention) parts.
FIXED_COST, QUADRATIC_COST = 48.0, 1 / 65536
WORD = r"[^\x20\x09-\x0D]+"
# Rows of one length and salt that a task ranks at most.
RANKED_TOGETHER = 500_000


def cost(length: float) -> float:
    return FIXED_COST + length + QUADRATIC_COST * length * length


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = SEQUENCE_LENGTHS) -> list[tuple]:
    """(length, first rank, end rank, first bin, items a bin, items before, words before).

    Item ``r`` of a length goes to bin ``first + (r - first rank) // items``. A length ends with
    one split at most, and a bin holds fewer than sqrt(2 * largest) different lengths, so there are
    fewer than 3 * lengths * sqrt(2 * largest) rows.
    """
    lengths = tuple(sorted(lengths))
    below = np.zeros(lengths[-1] + 1)  # words in all items up to a length
    for n, m in histogram.items():
        below[n] = n * m
    below = below.cumsum()
    groups: dict[int, list] = defaultdict(list)  # free space -> (first bin, bins, items, used)
    free: list[int] = []
    rows, bins = [], 0

    def put(space: int, group: tuple) -> None:
        if not groups[space]:
            insort(free, space)
        groups[space].append(group)

    def opened(n: int, m: int) -> int:
        def price(c: int) -> float:
            items = min(m, c // n)
            rest = c - items * n
            filler = below[min(rest, n - 1)] / -(-m // items)
            filled = items * n + min(rest, filler)
            return cost(next(x for x in lengths if x >= filled)) / filled
        return min((c for c in lengths if c >= n), key=price)

    for n in sorted(histogram, reverse=True):
        m, rank = histogram[n], 0
        while m:
            at = bisect_left(free, n)
            if at == len(free):
                c = opened(n, m)
                count = -(-m // (c // n))
                put(c, (bins, count, 0, 0))
                bins += count
                at = bisect_left(free, n)
            space = free[at]
            first, count, items, used = groups[space].pop()
            if not groups[space]:
                del free[at]
            each = min(space // n, m)
            full = min(count, m // each)
            rows.append((n, rank, rank + full * each, first, each, items, used))
            put(space - each * n, (first, full, items + each, used + each * n))
            if full < count:
                put(space, (first + full, count - full, items, used))
            rank, m = rank + full * each, m - full * each
    return rows


def pack(docs: DataFrame, lengths: tuple[int, ...] = SEQUENCE_LENGTHS) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin, position, start, bin_words, capacity of each piece."""
    largest, spark = max(lengths), docs.sparkSession
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("words"))
    counted = settled(counted.groupBy("doc_id", "body", "words").agg(F.count("*").alias("copies")))
    pieces = counted.where("words > 0").select(
        "doc_id", "body", "copies", "words",
        F.explode(F.expr(f"sequence(0, (words - 1) div {largest})")).alias("piece")).select(
        "doc_id", "body", "copies", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * largest).cast("long").alias("first_word"),
        F.expr(f"int(least({largest}, words - piece * {largest}))").alias("n_words"))

    histogram = {r.n_words: r.copies for r in pieces.groupBy("n_words").agg(
        F.sum("copies").alias("copies")).collect()}  # at most one row for each permitted length
    moves = np.array(plan(histogram, lengths), np.int64).reshape(-1, 7)
    names = ["n_words", "rank_from", "rank_to", "bin_from", "each", "items", "used"]
    moves = spark.createDataFrame(pa.table(
        {c: pa.array(moves[:, k], pa.int32() if c == "n_words" else pa.int64())
         for k, c in enumerate(names)}))
    salts = spark.createDataFrame(
        [(n, -(-m // RANKED_TOGETHER)) for n, m in histogram.items()], "n_words int, salts long")

    own = ["doc_id", "body", "piece"]
    salted = pieces.join(F.broadcast(salts), "n_words").withColumn(
        "salt", F.pmod(F.xxhash64(*own), "salts").cast("int"))
    part = Window.partitionBy("n_words", "salt").orderBy(*own).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = salted.groupBy("n_words", "salt").agg(F.sum("copies").alias("part")).withColumn(
        "before", F.coalesce(F.sum("part").over(
            Window.partitionBy("n_words").orderBy("salt").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0))).drop("part")
    ranked = salted.withColumn(
        "within", F.coalesce(F.sum("copies").over(part), F.lit(0))).join(
        sums, ["n_words", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(moves, ["n_words"]).where(
        (F.col("rank") < F.col("rank_to"))
        & (F.col("rank") + F.col("copies") > F.col("rank_from"))).withColumn(
        "nth", F.explode(F.expr("sequence(greatest(rank, rank_from) - rank_from,"
                                " least(rank + copies, rank_to) - 1 - rank_from)")))
    binned = placed.select(
        "doc_id", "piece", "first_word", "n_words",
        F.expr("bin_from + nth div each").alias("bin"),
        F.expr("items + nth % each").alias("position"),
        F.expr("used + (nth % each) * n_words").alias("start"))
    filled = binned.withColumn(
        "bin_words", F.sum("n_words").over(Window.partitionBy("bin")))
    fits = F.coalesce(*[F.when(F.col("bin_words") <= c, F.lit(c)) for c in sorted(lengths)])
    blank = counted.where("words = 0").withColumn(
        "copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_word"),
        F.lit(0).alias("n_words"))
    return filled.withColumn("capacity", fits).unionByName(blank, allowMissingColumns=True)
