"""Language identification by Bayesian fusion of text and metadata.

Text gives a likelihood under each language from letter trigrams; the counts come from all texts,
grouped by declared language. Three more sources of evidence are added in log space: the declared
language, an address suffix, and a prior of the host, smoothed towards its parents level by level.
Their tables are grouped aggregations over the text verdicts of all rows, so a wrong declaration of
some hosts shows as low reliability. A class ``und`` with uniform trigrams stands for texts in no
language.

Texts without letters have no text evidence and are ``und``; null counts as empty. Missing
metadata adds nothing. Ties go to the language listed first. Repeated rows get equal verdicts. With
no usable declared language at all, every row is ``und``. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import settled, whole_texts
from postlens.llm.words import Texts, chunks

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
GRAMS = 64 ** 3
# Neighbouring trigrams share letters; their evidence counts a third.
TEXT_WEIGHT = 1 / 3
UNKNOWN_PRIOR = 1e-4
# Weight of the parent level, in rows, when a level's counts are smoothed.
PARENT_ROWS = 20.0
PSEUDO = 0.5
SURE = 0.9

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Class of the trigram around every letter, and its text."""
    b = texts.buffer
    if len(b) < 1:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    capital = np.zeros(len(b), bool)  # the second byte of A-grave to Thorn
    capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    c = _CLASS[b + capital.astype(np.uint8) * np.uint8(32)].astype(np.int32)
    edge = np.zeros(len(b) + 1, bool)
    edge[texts.offsets] = True
    left = np.zeros(len(b), np.int32)
    left[1:] = np.where(edge[1:-1], 0, c[:-1])
    right = np.zeros(len(b), np.int32)
    right[:-1] = np.where(edge[1:-1], 0, c[1:])
    at = np.flatnonzero(c > 0)
    return (left[at] * 4096 + c[at] * 64 + right[at]), \
        np.searchsorted(texts.offsets, at, "right") - 1


def gram_counts(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Counts by language and trigram over all rows (columns text, declared)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), GRAMS), np.int64)
        for batch in batches:
            spoken = pc.index_in(batch.column("declared"), pa.array(languages)).to_numpy()
            for piece in chunks(batch.column("text")):
                gram, row = grams(piece)
                code = spoken[piece.first: piece.first + piece.rows][row].astype(np.int64)
                for k in range(len(languages)):
                    total[k] += np.bincount(gram[code == k], minlength=GRAMS)
        which, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(gram.astype(np.int32)),
             pa.array(total[which, gram])], ["k", "gram", "n"])

    known = rows.where(F.col("declared").isin(*languages)).select("text", "declared")
    summed = known.mapInArrow(count, "k int, gram int, n long").groupBy("k", "gram").agg(
        F.sum("n").alias("n")).toArrow()  # languages x trigrams at most
    out = np.zeros((len(languages), GRAMS))
    out[summed["k"].to_numpy(), summed["gram"].to_numpy()] = summed["n"].to_numpy()
    return out


def text_evidence(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """The rows without text, with ``score``: log-likelihood by language, last ``und``."""
    logs = np.log((counts + PSEUDO) / (counts.sum(1, keepdims=True) + PSEUDO * GRAMS))
    uniform = np.full((1, GRAMS), np.log(1 / 27 ** 3))
    table = np.ascontiguousarray(np.concatenate([logs, uniform]).T * TEXT_WEIGHT, np.float32)
    keep = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column("text")):
                gram, row = grams(piece)
                sums = np.stack([np.bincount(row, table[gram, k], piece.rows)
                                 for k in range(table.shape[1])], 1).astype(float)
                n = np.bincount(row, minlength=piece.rows)
                own = [batch.column(c)[piece.first: piece.first + piece.rows] for c in keep]
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(piece.rows + 1, dtype=np.int32) * table.shape[1]),
                    pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), flat], [*keep, "grams", "score"])

    fields = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keep)
    return rows.mapInArrow(score, f"{fields}, grams long, score array<double>")


def _chosen(score: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)),
                        F.array_position(score, F.array_max(score)).cast("int"))


def _added(score: Column, extra: Column) -> Column:
    return F.when(extra.isNull(), score).otherwise(F.zip_with(score, extra, lambda a, b: a + b))


def _tally(rows: DataFrame, key: str, languages: tuple[str, ...]) -> DataFrame:
    """Rows of each value of a key by their text verdict."""
    return rows.where(F.col(key).isNotNull() & F.col("verdict").isNotNull()).groupBy(key).agg(
        F.array(*[F.count(F.when(F.col("verdict") == k, 1)).cast("double") for k in languages])
        .alias("tally"))


def identify(docs: DataFrame, declared: Column, levels: list[Column], suffix: Column | None = None,
             text: str = "text", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """doc_id, body, declared, language, confidence and kept of each row.

    ``levels`` are the host's keys from coarse to fine (none repeats a value under two parents).
    """
    whole_texts(docs.sparkSession)
    names = [*languages, UNKNOWN]
    keys = [f"level{k}" for k in range(len(levels))]
    no_suffix = F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"),
        F.col(text).cast("string").alias("text"), declared.cast("string").alias("declared"),
        (no_suffix if suffix is None else suffix.cast("string")).alias("suffix"),
        *[c.cast("string").alias(k) for c, k in zip(levels, keys, strict=True)])
    scored = settled(text_evidence(rows, gram_counts(rows, languages)))
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    judged = scored.withColumn("verdict", F.when(
        (F.col("grams") > 0) & (1 / mass >= SURE), _chosen(F.col("score"), names)))

    # The share of each language over all rows, as the root of the hierarchy.
    total = judged.agg(*[F.count(F.when(F.col("verdict") == k, 1)).alias(k) for k in languages]).first()
    root = np.array([total[k] for k in languages], float) + 1
    root = root / root.sum()
    out, prior = judged, F.array(*[F.lit(float(p)) for p in root])
    for key in keys:
        table = _tally(judged, key, languages)
        out = out.join(table, key, "left")
        rows_of = F.aggregate("tally", F.lit(0.0), lambda a, x: a + x)
        prior = F.when(F.col("tally").isNull(), prior).otherwise(F.zip_with(
            "tally", prior, lambda n, p: n + PARENT_ROWS * p))
        out = out.withColumn("_prior", F.transform(
            prior, lambda x: x / (F.coalesce(rows_of + PARENT_ROWS, F.lit(1.0))))).drop("tally")
        prior = F.col("_prior")
    logs = F.concat(F.transform(prior, lambda p: F.log(p * (1 - UNKNOWN_PRIOR))),
                    F.array(F.lit(float(np.log(UNKNOWN_PRIOR)))))
    out = out.withColumn("score", F.zip_with("score", logs, lambda a, b: a + b)).drop("_prior")

    # How likely each declared language or suffix is, given the language of the text.
    sizes = F.array(*[F.lit(float(total[k])) for k in languages])
    for key in ("declared", "suffix"):
        share = _tally(judged, key, languages).withColumn("extra", F.concat(
            F.zip_with("tally", sizes, lambda n, m: F.log((n + PSEUDO) / (m + PSEUDO * 2 * len(names)))),
            F.array(F.lit(float(np.log(1 / (2 * len(names)))))))).drop("tally")
        out = out.join(share, key, "left").withColumn(
            "score", _added(F.col("score"), F.col("extra"))).drop("extra")
    blank = F.col("grams") == 0
    return out.select(
        "doc_id", "body", "declared",
        F.when(blank, UNKNOWN).otherwise(_chosen(F.col("score"), names)).alias("language"),
        F.when(blank, F.lit(0.0)).otherwise(1 / mass).alias("confidence")).withColumn(
        "kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= 0.5))
