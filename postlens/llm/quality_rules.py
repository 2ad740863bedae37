"""Quality rules: boosted trees over document statistics, with monotone constraints.

One pass turns each whole text into a row of statistics; the texts do not move. A bounded sample
of labelled rows (``MAX_TRAINING_ROWS``, those with the smallest hash of their id) fits the trees
on the driver, and the flat node arrays score all rows in batches. The constraints make more
repetition or more symbols never better.

Null and empty texts have no words and fail the base rule, like all texts under ten words. Without
usable labels (no rows, or one class only) the base rule decides alone. Repeated rows get equal
results; labels that repeat for an id count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import trees
from postlens.llm.store import settled, whole_texts
from postlens.llm.words import Texts, chunks, mix, per_row, shingles

MAX_TRAINING_ROWS = 20_000
KEEP_PROBABILITY = 0.5
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistic -> direction in which a higher value may move the verdict.
STATISTICS = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "same_as_previous": -1, "distinct_share": 0, "top_word_share": -1, "upper_share": -1,
    "mark_share": -1, "bar_share": -1, "digit_share": 0, "sentence_ends": 0, "lines_per_word": 0,
}
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the matrix of statistics of each text."""
    b, rows = texts.buffer, texts.rows
    starts, ends, row = texts.words()
    n = per_row(row, rows).astype(np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    letters = texts.counted(~space & ((b & 0xC0) != 0x80))
    symbols = texts.counted(_SYMBOLS[b])
    word = texts.hashes(starts, ends)

    window, first = shingles(word, row, WINDOW)
    order = np.argsort(keyed := mix(window ^ row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                       kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    repeated = per_row(row[np.cumsum(cover)[:-1] > 0], rows).astype(np.int64)

    line_starts, line_ends, line_row = texts.lines()
    filled = np.zeros(len(b) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    with_word = filled[line_ends] > filled[line_starts]
    line_row = line_row[with_word]
    lines = texts.hashes(line_starts[with_word], line_ends[with_word])
    again = len_again = np.zeros(rows, np.int64)
    if len(lines):
        pairs = np.unique(np.stack([line_row.astype(np.uint64), lines]), axis=1)
        len_again = per_row(line_row, rows).astype(np.int64)
        again = len_again - per_row(pairs[0].astype(np.int64), rows).astype(np.int64)

    words = np.maximum(n, 1)
    in_text = mix(word ^ row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(in_text, return_index=True, return_counts=True)
    distinct, top = per_row(row[at], rows), np.zeros(rows)
    np.maximum.at(top, row[at], times)
    next_to = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    marks = per_row(row[(b[ends - 1] == 33) | (b[ends - 1] == 63)], rows)
    ended = per_row(row[b[ends - 1] == 46], rows)
    x = np.stack([
        np.log1p(n), letters / words, symbols / words, again / np.maximum(len_again, 1),
        repeated / words, per_row(row[1:][next_to], rows) / words, distinct / words, top / words,
        texts.counted((b >= 65) & (b <= 90)) / np.maximum(letters, 1), marks / words,
        texts.counted(b == 124) / words, texts.counted((b >= 48) & (b <= 57)) / np.maximum(letters, 1),
        ended / words, len_again / words], 1)
    return dict(zip(COUNTS, (n, letters, symbols, again, repeated), strict=True)), x


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch.column("text")):
            counts, x = statistics(piece)
            ids = batch.column("doc_id")[piece.first: piece.first + piece.rows]
            matrix = pa.ListArray.from_arrays(
                pa.array(np.arange(piece.rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(counts[c]) for c in COUNTS), matrix], ["doc_id", *COUNTS, "x"])


def measure(docs: DataFrame) -> DataFrame:
    """The counts and statistics of every document."""
    whole_texts(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
                       .alias("text")).mapInArrow(_measured, SCHEMA)


def train(measured: DataFrame, labels: DataFrame, label: str = "quality",
          limit: int = MAX_TRAINING_ROWS) -> trees.Trees | None:
    """Trees from at most ``limit`` labelled rows, or none if there is nothing to learn."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    rows = measured.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "x")
    # Ids may repeat in the documents, so the bound holds for the joined rows as well.
    rows = rows.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "y").limit(limit).collect()
    y = np.array([r.y > 0 for r in rows], float)
    if len(set(y)) < 2:
        return None
    return trees.fit(np.array([r.x for r in rows]), y, list(STATISTICS.values()))


def score(measured: DataFrame, labels: DataFrame, keep: float = KEEP_PROBABILITY,
          limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    model = train(measured, labels, limit=limit)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed)
    if model is None:
        return out.withColumn("quality", F.lit(None).cast("double")) \
            .withColumn("kept", ~F.col("base_failed")).drop("x")

    @F.pandas_udf("double")
    def probability(x):
        matrix = np.stack(x.to_list()) if len(x) else np.zeros((0, len(STATISTICS)))
        return type(x)(1 / (1 + np.exp(-model.margins(matrix))))

    return out.withColumn("quality", probability("x")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= keep)).drop("x")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, quality and kept of every document."""
    return score(settled(measure(docs)), labels)
