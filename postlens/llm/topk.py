"""Exact top-k search by columnar branch-and-bound.

Vectors are scaled to integers. A task holds a block of them in vertical layout, one row per
dimension, and adds up the inner products dimension block by dimension block. After each one a
candidate can reach at most its partial score plus the product of what is left of both lengths
(Cauchy-Schwarz); candidates that cannot reach the query's k-th best score any more are gone. While
many are left the whole block is multiplied; once few are, the survivors are compacted to pairs.

The k-th best score is first known from ``SEED_SHARE`` of the vectors, which are searched ahead of the
others; each task then raises it by its own finds. It returns only rows that beat it (an equal
score with a smaller id does), so what is shuffled stays near k rows per query and task at most.
Queries are a stated part of the rows. They are read in blocks of at most ``QUERY_VALUES`` numbers,
which bounds what goes to a task, and each block meets all vectors.

Scores are 64-bit inner products of floor(scale * x), x as double; equal scores go to the smaller id, a
null id being the largest. Vectors that are null or have null or non-finite components take no part;
shorter ones count as filled up with zeros. Equal (id, vector) rows are one query; as candidates,
repeated rows each count. Rows with the query's id are not its candidates. An empty table, or one
without queries, gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.store import written

# Numbers of all vectors of a query block: 8 bytes each are sent to every task.
QUERY_VALUES = 1 << 20
# Vectors of a block, queries that meet it at a time, and dimensions per step.
VECTORS, TILE, STEP = 4096, 128, 8
SEED_SHARE = 16
# Below this share of survivors, pairs are followed one by one.
SPARSE = 0.02
NO_ID = np.iinfo(np.int64).max
_FOUND = "query long, vec_id long, score long"


def scaled(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v, seed) of the vectors that take part, as integers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        rows.select(F.col(id_column).cast("long").alias("id"),
                    F.col(vector_column).cast("array<double>").alias("v"))
        .where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("id", F.transform("v", lambda x: F.floor(x * scale)).cast("array<long>").alias("v"))
        .withColumn("seed", F.pmod(F.xxhash64("id", "v"), F.lit(SEED_SHARE)) == 0))


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; what a list lacks is zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def masses(rows: np.ndarray, edges: list[int]) -> np.ndarray:
    """Length of what is left of each row behind each edge, a little more than it is."""
    squares = np.concatenate([np.cumsum((rows * rows)[:, ::-1], 1)[:, ::-1], np.zeros((len(rows), 1))], 1)
    return np.sqrt(np.maximum(squares[:, edges], 0)) * (1 + 1e-9)


class Queries:
    """A block of queries with the score to beat for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.width = vectors.shape[1]
        self.edges = [*range(STEP, self.width, STEP), self.width]
        # Dimensions in which queries have most of their length come first.
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
        self.floats = vectors[:, self.order].astype(np.float64)
        self.rest = masses(self.floats, self.edges)
        self.score = np.full(len(ids), np.iinfo(np.int64).min)
        self.last = np.full(len(ids), NO_ID)

    def __len__(self) -> int:
        return len(self.ids)


class Search:
    """The search of one task: best finds of each query over the blocks seen so far."""

    def __init__(self, queries: Queries):
        self.q = queries
        self.score, self.last = queries.score.copy(), queries.last.copy()
        self.lengths = masses(queries.floats, [0])[:, 0]
        self.best: dict[int, list[tuple[int, int]]] = {}

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors[:, self.q.order].T.astype(np.float64))
        rest = masses(columns.T, self.q.edges)
        longest = float(masses(columns.T, [0]).max(initial=0.0))
        for start in range(0, len(self.q), TILE):
            tile = slice(start, min(start + TILE, len(self.q)))
            row, at = self._survivors(tile, columns, rest, longest)
            if len(row):
                self._keep(row + start, ids[at], self._exact(row + start, vectors[at]))

    def _exact(self, query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.q.vectors[query], vectors)

    def _survivors(self, tile: slice, columns: np.ndarray, rest: np.ndarray,
                   longest: float) -> tuple[np.ndarray, np.ndarray]:
        """(query in the tile, vector) of the pairs that may reach the score to beat."""
        own, own_rest = self.q.floats[tile], self.q.rest[tile]
        goal = self.score[tile].astype(np.float64)
        # Sums of doubles are not exact beyond 2**53.
        goal -= 0.5 + 1e-12 * self.lengths[tile] * longest
        partial = np.zeros((len(own), columns.shape[1]))
        low, row, at, done = 0, None, None, None
        for step, high in enumerate(self.q.edges):
            if row is None:
                partial += own[:, low:high] @ columns[low:high]
                alive = partial + own_rest[:, step, None] * rest[None, :, step] >= goal[:, None]
                if high < self.q.width and alive.mean() >= SPARSE:
                    low = high
                    continue
                row, at = np.nonzero(alive)  # compact the survivors
                done = partial[row, at]
            else:
                done += np.einsum("ij,ji->i", own[row, low:high], columns[low:high, at])
                alive = done + own_rest[row, step] * rest[at, step] >= goal[row]
                row, at, done = row[alive], at[alive], done[alive]
            if not len(row):
                break
            low = high
        return row, at

    def _keep(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = (scores > self.score[query]) | ((scores == self.score[query]) & (ids < self.last[query]))
        better &= (ids != self.q.ids[query])
        query, ids, scores = query[better], ids[better], scores[better]
        for one in np.unique(query):
            own = query == one
            found = self.best.get(one, []) + list(zip((-scores[own]).tolist(), ids[own].tolist(), strict=True))
            found = self.best[one] = sorted(found)[: self.q.k]
            if len(found) == self.q.k and (-found[-1][0], -found[-1][1]) > (self.score[one], -self.last[one]):
                self.score[one], self.last[one] = -found[-1][0], found[-1][1]

    def rows(self) -> pa.RecordBatch:
        found = [(q, i, -s) for q, best in self.best.items() for s, i in best]
        ids = [None if i == NO_ID else int(i) for _, i, _ in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(q) for q, _, _ in found], pa.int64()), pa.array(ids, pa.int64()),
             pa.array([int(s) for _, _, s in found], pa.int64())], ["query", "vec_id", "score"])


def searcher(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                ids = part.column("id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                search.block(ids, dense(part.column("v"), search.q.width))
        yield search.rows()
    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best finds of each query; tasks return k rows a query at most."""
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def _raise(queries: Queries, rows: list) -> None:
    """Set the scores to beat from the k-th best seeds."""
    for row in rows:
        if row["rank"] == queries.k:
            queries.score[row["query"]] = row["score"]
            queries.last[row["query"]] = NO_ID if row["vec_id"] is None else row["vec_id"]


def top_k(rows: DataFrame, asked: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose ``id`` meets ``asked``."""
    spark = rows.sparkSession
    vectors = written(scaled(rows, id_column, vector_column, scale))
    queries = vectors.where(asked).select("id", "v").distinct()
    total, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = -(-(total * max(width or 1, 1)) // QUERY_VALUES)
    out = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == part)
        table = mine.toArrow()  # QUERY_VALUES numbers, give or take the chance of a hash
        if not table.num_rows:
            continue
        block = Queries(table.column("id").to_numpy(), dense(table.column("v"), width), k)
        seeds = written(best_of(vectors.where("seed").mapInArrow(
            searcher(spark.sparkContext.broadcast(block)), _FOUND), k))
        _raise(block, seeds.where(F.col("rank") == k).collect())  # one row a query of the block
        rest = vectors.where("not seed").mapInArrow(searcher(spark.sparkContext.broadcast(block)), _FOUND)
        names = spark.createDataFrame(
            pa.table({"query": pa.array(np.arange(len(block))), "query_id": table.column("id")}))
        best = best_of(seeds.drop("rank").union(rest), k).join(F.broadcast(names), "query").select(
            "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        out = best if out is None else out.union(best)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out
