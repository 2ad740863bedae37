"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to one of a fixed number of ring cells. Each shard has virtual nodes on the ring and
a capacity; a cell belongs to the next virtual node clockwise whose shard has room, and what
does not fit goes on clockwise. Only the counts of the cells (a fixed number) reach the driver,
which settles which ranks of which cell go to which shard; rows find their place by their rank
in their cell, so the walk is exact without moving texts or ordering the table as a whole.

With slack 0 the capacities add up to the number of rows and differ by one at most, so counts do
too. With slack e no shard has more than (1 + e) times its even share, and fewer rows move when
a shard is added.

Null texts count as empty (size 8, crc 0); a null doc_id is a value like any other; repeated rows
are counted first and get one place each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.sources.layout import settled

CELLS = 1 << 15
VIRTUAL_NODES = 128
KEY = ["cell", "doc_id", "size", "text_crc32"]
# A row that stands for more copies than this is dealt out in parts of this size.
COPIES = 10_000


def node_cells(shards: int, nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a shard's nodes depend on it alone."""
    def place(shard: int, node: int) -> int:
        return int.from_bytes(blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()) % cells
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def walk(counts: np.ndarray, shards: int, slack: float = 0.0,
         nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of the bounded-load ring."""
    cells, total = len(counts), int(counts.sum())
    if slack:
        room = [-(-int(total * (1 + slack)) // shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    ring = node_cells(shards, nodes, cells)
    after = [(at + 1) % len(ring) for at in range(len(ring))]

    def open_node(at: int) -> int:
        full = []
        while room[ring[at][1]] == 0:
            full.append(at)
            at = after[at]
        for node in full:
            after[node] = at
        return at

    first = np.searchsorted([c for c, _ in ring], np.arange(cells), "left") % len(ring)
    slots, parts = [0] * shards, []
    for cell in np.flatnonzero(counts):
        left, rank = int(counts[cell]), 0
        while left:
            shard = ring[open_node(int(first[cell]))][1]
            take = min(left, room[shard])
            parts.append((int(cell), rank, rank + take, shard, slots[shard]))
            room[shard] -= take
            slots[shard] += take
            rank, left = rank + take, left - take
    return parts


def shard_rows(docs: DataFrame, shards: int, slack: float = 0.0, cells: int = CELLS,
               nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    keyed = keyed.withColumn("cell", F.pmod(F.xxhash64(*KEY[1:]), F.lit(cells)).cast("int"))
    distinct = settled(keyed.groupBy(KEY).agg(F.count("*").alias("copies")))

    counts = np.zeros(cells, np.int64)
    for cell, n in distinct.groupBy("cell").agg(F.sum("copies")).collect():  # one row a cell
        counts[cell] = n
    # At most one part a cell and one for each time a shard fills up, so cells + shards at most.
    parts = docs.sparkSession.createDataFrame(
        walk(counts, shards, slack, nodes),
        "part_cell int, part_start long, part_end long, shard int, slot_start long")

    ranks = Window.partitionBy("cell").orderBy(*KEY[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ranged = distinct.withColumn("start", F.coalesce(F.sum("copies").over(ranks), F.lit(0)))
    placed = ranged.join(
        F.broadcast(parts),
        (F.col("cell") == F.col("part_cell")) & (F.col("start") < F.col("part_end"))
        & (F.col("start") + F.col("copies") > F.col("part_start")))
    placed = placed.select(
        *KEY[1:], "shard",
        (F.col("slot_start") - F.col("part_start")).alias("shift"),
        F.greatest("start", "part_start").alias("low"),
        F.least(F.col("start") + F.col("copies"), "part_end").alias("high"))
    dealt = placed.withColumn("from", F.explode(F.expr(f"sequence(low, high - 1, {COPIES}L)")))
    dealt = dealt.hint("rebalance").withColumn(
        "rank", F.explode(F.expr(f"sequence(from, least(from + {COPIES}L, high) - 1)")))
    return dealt.select(
        *KEY[1:], F.lit("rows" if not slack else "bytes").alias("law"), "shard",
        (F.col("rank") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
