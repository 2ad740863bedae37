"""Ranked lexical search over norm buckets of impact vectors.

The score of a document for an item is an inner product: how often the item holds a term, times the
impact of the term in the document. Only terms of the items can count, so a document is kept as the
sparse vector of the impacts of those terms. Vectors are ordered by length and searched in buckets,
longest first. A bucket is skipped for an item if the lengths (Cauchy-Schwarz) cannot reach the
item's k-th best score. Inside a bucket the item's heaviest coordinates are added up first; what the
others can add is bounded by the lengths that are left and by the largest impacts of the bucket.
Documents that may still reach the score are scored exactly in 64-bit integers.

The score to beat is first known from ``SEED_SHARE`` of the vectors, searched ahead of the others, and
rises with the finds of the task. A task returns only documents that beat it, k for each item at
most. Items are the stated query set: they are read in blocks of about ``BLOCK_TERMS`` terms, which
bounds what goes to a task, and each block meets all documents.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. They are
compared by 64-bit hashes: with a million terms in the items and a billion in the documents, the
chance that any two agree is about one in 20,000. Null and empty texts have no term and no place.
Equal scores go to the smaller doc_id, null being the largest; repeated documents each have a place.
Equal (item_id, text) rows are one item; an item without terms or hits gives no row. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.store import settled, small_batches, written
from postlens.llm.words import Texts, chunks

# Distinct terms of the items of a block, as an estimate from their bytes: a term takes four or more.
BLOCK_TERMS = 1 << 20
# Documents of a bucket, and impacts that it holds unless a single document has more.
BUCKET, ENTRIES = 4096, 1 << 20
SEED_SHARE = 16
# Coordinates of an item that are added up before documents are dropped.
FOCUS = 8
NO_ID = np.iinfo(np.int64).max
_FOUND = "item long, doc_id long, score long"

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term, as signed numbers."""
    starts, ends, row = texts._spans(_TERM[texts.buffer])
    return texts.hashes(starts, ends, lower=True).view(np.int64), row


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# --- items ------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, times): the distinct terms of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column("text")):
                hashes, row = term_hashes(piece)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])][: len(row)])
                times = np.diff(np.r_[first, len(row)])
                sizes = np.bincount(row[first], minlength=piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(piece.first, piece.rows),
                     _lists(hashes[first], sizes, pa.int64()), _lists(times, sizes, pa.int64())],
                    ["item_id", "terms", "times"])
    return items.mapInArrow(run, "item_id long, terms array<long>, times array<long>")


class Items:
    """A block of items over the sorted hashes of their terms."""

    def __init__(self, table: pa.Table, k: int):
        self.k, self.ids = k, table.column("item_id")
        terms = table.column("terms").combine_chunks()
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
        flat = terms.flatten().to_numpy(zero_copy_only=False)
        self.vocabulary, at = np.unique(flat, return_inverse=True)
        times = table.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        edges = np.cumsum(sizes)[:-1]
        self.terms, self.times = np.split(at, edges), np.split(times, edges)
        self.lengths = np.array([np.sqrt(float((t * t).sum())) for t in self.times])
        self.score = np.zeros(len(self.times), np.int64)  # a score has to be above 0
        self.last = np.full(len(self.times), np.iinfo(np.int64).min)

    def __len__(self) -> int:
        return len(self.times)


# --- documents ----------------------------------------------------------------------


def document_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tf): length in terms, and numbers and counts of those the items hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        # Most terms are in no item: a table over leading bits tells without a search.
        shift = np.uint64(64 - 20)
        listed = np.zeros(1 << 20, bool)
        listed[known.view(np.uint64) >> shift] = True
        for batch in batches:
            for piece in chunks(batch.column("text")):
                hashes, row = term_hashes(piece)
                n = np.bincount(row, minlength=piece.rows)
                hit = np.flatnonzero(listed[hashes.view(np.uint64) >> shift])
                hashes, row = hashes[hit], row[hit]
                at = np.searchsorted(known, hashes)
                same = known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(len(at), bool)
                pairs, tf = np.unique(row[same] * np.int64(max(len(known), 1)) + at[same], return_counts=True)
                owner, term = np.divmod(pairs, max(len(known), 1))
                sizes = np.bincount(owner, minlength=piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.first, piece.rows), pa.array(n, pa.int64()),
                     _lists(term, sizes, pa.int32()), _lists(tf, sizes, pa.int32())],
                    ["doc_id", "n", "terms", "tf"])
    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def weights(vectors: DataFrame, terms: int, documents: int) -> np.ndarray:
    """Weight of every term of the items, from the number of documents that hold it."""
    df = np.zeros(terms, np.int64)
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for batch in held.toArrow().to_batches():  # one row a term of the block
        df[batch.column("term").to_numpy()] = batch.column("df").to_numpy()
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(n: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, weight: np.ndarray,
            documents: int, length: int) -> np.ndarray:
    """Impact of each term in its document, in 64-bit integers."""
    m = 75 + (25 * n * documents) // max(length, 1)
    return weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and counts of the rows of a batch."""
    lists = batch.column("terms")
    return (lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
            lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def with_length(vectors: DataFrame, corpus) -> DataFrame:
    """Add the length of the impact vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, documents, length = corpus.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            sizes, terms, tf = _sparse(batch)
            x = impacts(n, terms, tf, sizes, weight, documents, length).astype(np.float64)
            norm = np.sqrt(np.maximum(_sums(x * x, sizes), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], [*batch.schema.names, "length"])
    schema = "doc_id long, n long, terms array<int>, tf array<int>, length double"
    return vectors.mapInArrow(run, schema)


# --- search -----------------------------------------------------------------------------


class Bucket:
    """Documents of similar length: impacts by document and by term."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, x: np.ndarray):
        self.ids, self.sizes, self.terms, self.x = ids, sizes, terms, x
        self.start = np.cumsum(sizes) - sizes
        f = x.astype(np.float64)
        self.mass = np.maximum(np.bincount(np.repeat(np.arange(len(sizes)), sizes), f * f, len(sizes)), 0)
        self.longest = float(np.sqrt(self.mass.max(initial=0.0)))
        order = np.argsort(terms, kind="stable")
        self.by_term = terms[order]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.f = f[order]
        self.held, first = np.unique(self.by_term, return_index=True)
        self.first = np.r_[first, len(order)]
        self.top = np.maximum.reduceat(self.f, first) if len(first) else np.zeros(0)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in ``held``, or -1."""
        at = np.minimum(np.searchsorted(self.held, terms), max(len(self.held) - 1, 0))
        return np.where(self.held[at] == terms, at, -1) if len(self.held) else np.full(len(terms), -1)

    def exact(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer scores of documents for an item given as counts by term."""
        sizes = self.sizes[docs]
        at = np.repeat(self.start[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return _sums(query[self.terms[at]] * self.x[at], sizes)


class Search:
    """The search of one task: best finds of each item over the buckets seen so far."""

    def __init__(self, items: Items):
        self.items = items
        self.score, self.last = items.score.copy(), items.last.copy()
        self.best: dict[int, list[tuple[int, int]]] = {}
        self.query = np.zeros(len(items.vocabulary), np.int64)

    def bucket(self, bucket: Bucket) -> None:
        reach = self.items.lengths * bucket.longest * (1 + 1e-9)
        for one in np.flatnonzero(reach >= np.maximum(self.score, 1)):
            self._inside(int(one), bucket)

    def _inside(self, one: int, bucket: Bucket) -> None:
        goal = max(int(self.score[one]), 1) * (1 - 1e-9) - 0.5
        terms, times = self.items.terms[one], self.items.times[one].astype(np.float64)
        at = bucket.places(terms)
        terms, times, at = terms[at >= 0], times[at >= 0], at[at >= 0]
        most = times * bucket.top[at]
        if most.sum() * (1 + 1e-9) < goal:
            return
        order = np.argsort(-most, kind="stable")
        focus, others = order[:FOCUS], order[FOCUS:]
        partial, seen = np.zeros(len(bucket.ids)), np.zeros(len(bucket.ids))
        for t in focus:
            span = slice(bucket.first[at[t]], bucket.first[at[t] + 1])
            docs, x = bucket.doc[span], bucket.f[span]
            partial[docs] += times[t] * x  # a document holds a term once
            seen[docs] += x * x
        left = np.sqrt((times[others] ** 2).sum()) * np.sqrt(np.maximum(bucket.mass * (1 + 1e-9) - seen, 0))
        alive = np.flatnonzero((partial + np.minimum(left, most[others].sum())) * (1 + 1e-9) >= goal)
        if len(alive):
            self.query[self.items.terms[one]] = self.items.times[one]
            scores = bucket.exact(alive, self.query)
            self.query[self.items.terms[one]] = 0
            self._keep(one, bucket.ids[alive], scores)

    def _keep(self, one: int, ids: np.ndarray, scores: np.ndarray) -> None:
        low, last = int(self.score[one]), int(self.last[one])
        better = np.flatnonzero((scores > low) | ((scores == low) & (ids < last)))
        if not len(better):
            return
        better = better[np.lexsort((ids[better], -scores[better]))][: self.items.k]
        found = self.best.get(one, []) + list(zip((-scores[better]).tolist(), ids[better].tolist(), strict=True))
        found = self.best[one] = sorted(found)[: self.items.k]
        if len(found) == self.items.k and (-found[-1][0], -found[-1][1]) > (low, -last):
            self.score[one], self.last[one] = -found[-1][0], found[-1][1]

    def rows(self) -> pa.RecordBatch:
        found = [(q, i, -s) for q, best in self.best.items() for s, i in best]
        ids = [None if i == NO_ID else int(i) for _, i, _ in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(q) for q, _, _ in found], pa.int64()), pa.array(ids, pa.int64()),
             pa.array([int(s) for _, _, s in found], pa.int64())], ["item", "doc_id", "score"])


def buckets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of bounded size."""
    total = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, before + ENTRIES, "right"))), at + BUCKET, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def searcher(sent, corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, (weight, documents, length) = Search(sent.value), corpus.value
        for batch in batches:
            for part in buckets(batch):
                sizes, terms, tf = _sparse(part)
                x = impacts(part.column("n").to_numpy(), terms, tf, sizes, weight, documents, length)
                ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                search.bucket(Bucket(ids, sizes, terms, x))
        yield search.rows()
    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best finds of each item; tasks return k rows an item at most."""
    ranks = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = settled(items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (4 * BLOCK_TERMS))
    out = None
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = _ranked(texts, Items(item_terms(mine).toArrow(), k))
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _ranked(texts: DataFrame, block: Items) -> DataFrame:
    spark = texts.sparkSession
    context = spark.sparkContext
    with small_batches(spark):
        counted = written(document_terms(texts, context.broadcast(block.vocabulary)))
        documents, length = counted.where("n > 0").agg(
            F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        corpus = context.broadcast((weights(counted, len(block.vocabulary), documents), documents, length))
        placed = with_length(counted.where(F.size("terms") > 0), corpus)
        # Equal lengths are spread by the id and the place in the input.
        keys = [F.desc("length"), F.asc("doc_id"), F.asc("row")]
        vectors = written(
            placed.withColumn("row", F.monotonically_increasing_id())
            .repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("seed", F.pmod(F.xxhash64("row"), F.lit(SEED_SHARE)) == 0).drop("row"))
        columns = ["doc_id", "n", "terms", "tf"]
        seeds = written(best_of(vectors.where("seed").select(*columns).mapInArrow(
            searcher(context.broadcast(block), corpus), _FOUND), block.k))
        for row in seeds.where(F.col("rank") == block.k).collect():  # one row an item of the block
            block.score[row["item"]] = row["score"]
            block.last[row["item"]] = NO_ID if row["doc_id"] is None else row["doc_id"]
        rest = written(vectors.where("not seed").select(*columns).mapInArrow(
            searcher(context.broadcast(block), corpus), _FOUND))
    names = spark.createDataFrame(pa.table({
        "item": pa.array(np.arange(len(block)), pa.int64()), "item_id": block.ids}))
    return best_of(seeds.drop("rank").union(rest), block.k).join(F.broadcast(names), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
