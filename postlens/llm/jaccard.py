"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Sets of shingles with equal content are one node. In an order of all shingles that puts frequent
ones last, two sets above the threshold share a shingle among the first few of each (prefix
filter), so a tile is all nodes with that shingle in one band of sizes: a band ends where the next
size is too large for a link. The order comes from a histogram of hashed shingles over all texts;
any order is right, a good one keeps tiles small.

1. Star round: every node of a tile is compared with the tile's leader only, the set with most
   frequent shingles. Tiles that many copies share are thereby linked in linear work. Tiles of very
   frequent shingles are salted: their parts have leaders of their own, which meet the least of them.
2. Tile rounds: nodes that are still in different components meet in their tile, in blocks of
   bounded size. A bitmap of each set, as wide as its size asks for, bounds the overlap from above:
   members of one set whose bit is clear in the other cannot be shared. Pairs inside a component
   need no further comparison; so the first tile round takes the likeliest pair of each two
   components in a meeting, and only the last round all that are left.
3. In each round, pairs that pass the bound are compared exactly, by intersection of the sorted
   shingle hashes of their whole texts, and the links give the components.

No partner, bin or candidate is capped. Words are compared with A-Z lower-cased. A text of fewer
words than a shingle is one shingle; null, empty and blank texts have none and link with nothing,
not even each other. A component is named by its least doc_id, nulls left out; if all are null the
name is null. Repeated rows share a component. Nodes are 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.components import components
from postlens.llm.store import once, release_shuffles, sent_if_small, settled, whole_texts, without, written
from postlens.llm.words import chunks, mix, shingles

SHINGLE, PERCENT = 4, 85
# Bits of a signature for each shingle, rounded up to a power of two.
BITS_EACH, LEAST_BITS = 6, 256
# Buckets of the histogram behind the order, and slices it is summed in; its memory is fixed.
BUCKETS, SLICES = 1 << 23, 64
# A frequent shingle's tile has a part for every so many documents.
SALT_ROWS = 50_000
# Two blocks of about this many nodes meet at a time.
BLOCK = 1024
# Rows unpacked at a time.
SLICE = 2048


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    for piece in chunks(texts):
        starts, ends, row = piece.words()
        hashes = piece.hashes(starts, ends, lower=True)
        feature, at = shingles(hashes, row, size)
        bounds = np.searchsorted(row[at], np.arange(piece.rows + 1))
        words = np.searchsorted(row, np.arange(piece.rows + 1))
        for k in range(piece.rows):
            if bounds[k] < bounds[k + 1]:
                yield np.unique(feature[bounds[k]: bounds[k + 1]])
            elif words[k] < words[k + 1]:
                own = hashes[words[k]: words[k + 1]]
                yield shingles(own, np.zeros(len(own), int), len(own))[0]
            else:
                yield np.zeros(0, np.uint64)


def bucket(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(BUCKETS - 1)).astype(np.int64)


class Order:
    """Rank of a shingle by the count of its bucket, and the buckets whose tiles are salted.

    The counts come in slices (place and counts), of which one is held at a time.
    """

    def __init__(self, slices: Iterable[tuple[int, np.ndarray]]):
        self.rank, sum_, large = np.zeros(BUCKETS, np.uint8), 0, []
        for k, counts in slices:
            first = k * len(counts)
            self.rank[first: first + len(counts)] = np.minimum(255, 8 * np.log2(1.0 + counts))
            sum_ += int(counts.sum())
            at = np.flatnonzero(counts > SALT_ROWS)  # few: their counts add up to the rows
            large.append((first + at, counts[at]))
        mean = sum_ / BUCKETS
        noise = mean + 6 * np.sqrt(mean)
        self.frequent = min(255, int(8 * np.log2(1.0 + noise)) + 1)
        large.sort(key=lambda x: x[0][0] if len(x[0]) else -1)
        places = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in large)])
        extra = np.concatenate([np.zeros(0), *(n for _, n in large)]) - noise
        self.hot = places[extra > SALT_ROWS]
        self.parts = (1 + extra[extra > SALT_ROWS] // SALT_ROWS).astype(np.int32)

    def salts(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(buckets), np.int32)
        at = np.minimum(np.searchsorted(self.hot, buckets), len(self.hot) - 1)
        return np.where(self.hot[at] == buckets, self.parts[at], 1).astype(np.int32)


def shingle_order(docs: DataFrame, size: int) -> Order:
    """The order from a histogram of the sets of all documents."""
    width = BUCKETS // SLICES

    def out(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
        data = [pa.compress(x.astype(np.int64).tobytes(), "zstd", asbytes=True) for x in slices.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array(data, pa.binary())],
                                          ["slice", "counts"])

    def read(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, 8 * width, "zstd", asbytes=True), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for own in sets_of(batch.column("text"), size):
                total[bucket(own)] += 1
        yield out(dict(enumerate(total.reshape(SLICES, width))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums[k] + read(data) if k in sums else read(data)
        yield out(sums)

    schema = "slice int, counts binary"
    summed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema).repartition(
        SLICES, "slice").mapInArrow(add, schema)
    # SLICES rows of fixed size
    return Order((row.slice, read(bytes(row.counts))) for row in summed.toLocalIterator())


def signature(own: np.ndarray) -> bytes:
    """One bit for each member, in a bitmap whose size is a power of two."""
    grid = np.zeros(max(LEAST_BITS, 1 << int(BITS_EACH * len(own) - 1).bit_length()), bool)
    grid[(own >> np.uint64(21)) & np.uint64(len(grid) - 1)] = True
    return np.packbits(grid).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (last axis) brought to a smaller width."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def overlap_bound(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles that sets with these sizes and bitmaps of one width can share."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def reaches(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def compatible(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def described(docs: DataFrame, size: int, percent: int, order: Order) -> DataFrame:
    """doc_id, body, n, node of each row; what tiles need where a task first meets the node.

    ``common`` is the share of frequent shingles in the set, from 0 to 255.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def prefix(own: np.ndarray) -> tuple[int, bytes, bytes]:
        rank = sent.value.rank[bucket(own)]
        first = own[np.lexsort((own, rank))[: len(own) - -(-percent * len(own) // 100) + 1]]
        salts = sent.value.salts(bucket(first))
        common = int(255 * (rank >= sent.value.frequent).mean())
        return common, first.tobytes(), salts.tobytes() if salts.max() > 1 else b""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for own in sets_of(batch.column("text"), size):
                node = None
                if len(own):
                    total = mix(own ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64) + np.uint64(len(own))
                    node = int(total.astype(np.int64))
                if node is None or node in seen:
                    rows.append((len(own), node, None, None, None, None))
                else:
                    seen.add(node)
                    rows.append((len(own), node, signature(own), *prefix(own)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"),
                 *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
                ["doc_id", "body", "n", "node", "bits", "common", "keys", "salts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        describe, "doc_id long, body long, n long, node long, bits binary, common long, keys binary, salts binary")


def tile_rows(nodes: DataFrame) -> DataFrame:
    """key, part, node, size: one row for each shingle of a node's prefix; part 0 if it is not salted.

    ``size`` holds n and, above 40 bits, ``common``.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                rows = batch.slice(k, SLICE)
                keys = [np.frombuffer(x, np.int64) for x in rows.column("keys").to_pylist()]
                times = [len(x) for x in keys]
                salts = np.concatenate([
                    np.frombuffer(x, np.int32) if x else np.ones(t, np.int32)
                    for x, t in zip(rows.column("salts").to_pylist(), times, strict=True)])
                node = np.repeat(rows.column("node").to_numpy(), times)
                part = np.where(salts > 1, 1 + node % salts, 0).astype(np.int32)
                own = rows.column("n").to_numpy() + (rows.column("common").to_numpy() << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.concatenate(keys), part, node, np.repeat(own, times))],
                    ["key", "part", "node", "size"])
    return nodes.select("node", "n", "common", "keys", "salts").mapInArrow(
        spread, "key long, part int, node long, size long")


def shared_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """tile, node, n, leader, hot: the rows that have a second node in their tile.

    A part of a salted tile (``hot``) is kept whole, for its partners may be in other parts.
    """
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition of narrow rows, as large as the shuffle makes it; frequent keys are salted.
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        key, part, node, n = (table[c].to_numpy() for c in ("key", "part", "node", "size"))
        n, common = n & ((1 << 40) - 1), n >> 40
        order = np.lexsort((node, n, part, key))
        key, part, node, n, common = key[order], part[order], node[order], n[order], common[order]
        other = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        fresh = other | np.r_[True, node[1:] != node[:-1]]  # several tasks may have met a node
        key, part, node, n, common, other = (x[fresh] for x in (key, part, node, n, common, other))
        gap = np.r_[True, (part[1:] == 0) & (100 * n[:-1] < percent * n[1:])]
        starts = np.flatnonzero(other | gap)
        sizes = np.diff(np.r_[starts, len(key)])
        at = np.flatnonzero((np.repeat(sizes, sizes) > 1) | (part > 0))
        band = mix((key[starts] ^ (n[starts] * 0x9E3779B1)).view(np.uint64)).view(np.int64)
        tile = np.where(part > 0, key, np.repeat(band, sizes))
        group = np.repeat(np.arange(len(starts)), sizes)
        best = np.lexsort((node, -common, group))[starts]  # starts are where groups begin in any such order
        leader = np.repeat(node[best], sizes)
        for k in range(0, len(at), 65536):
            s = at[k: k + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (tile[s], node[s], n[s].astype(np.int32), leader[s], part[s] > 0)],
                ["tile", "node", "n", "leader", "hot"])

    return rows.repartition("key", "part").mapInArrow(
        lead, "tile long, node long, n int, leader long, hot boolean")


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose bitmaps allow a link."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for na, nb, a, b in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b")),
                                    strict=True):
                width = min(len(a), len(b))
                a, b = (folded(np.frombuffer(x, np.uint8), width) for x in (a, b))
                ok.append(reaches(overlap_bound(na, nb, a, b), na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    joined = pairs.join(left, "a").join(right, "b").where(compatible("na", "nb", percent))
    return joined.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by exact intersection."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = sent_if_small(settled(nodes.join(needed, "node").select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "node")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    texts = written(texts.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")))
        .select("node", "text").dropDuplicates(["node"]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, ok = batch.slice(k, 256), []
                for a, b in zip(sets_of(part.column("text_a"), size), sets_of(part.column("text_b"), size),
                                strict=True):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(reaches(shared, len(a), len(b), percent))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def meeting(rows: list[tuple], percent: int, likeliest: bool) -> np.ndarray:
    """Pairs of one meeting: rows of (own, node, n, leader, label, bits) by size; two blocks meet if
    ``own`` differs among them. ``likeliest``: one pair, of the greatest bound, for each two labels."""
    own, node, n, leader, label = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
    widths = np.array([len(r[5]) for r in rows])
    # The bitmaps at least as wide as w, folded to it, and the rows they belong to.
    wide = {w: np.flatnonzero(widths >= w) for w in set(widths.tolist())}
    levels = {w: np.stack([folded(np.frombuffer(rows[k][5], np.uint8), w) for k in own_rows])
              for w, own_rows in wide.items()}
    across = bool((own != own[0]).any())
    found = [np.zeros((5, 0), np.int64)]
    ends = np.searchsorted(n, 100 * n // percent, "right")
    for k, end in enumerate(ends):  # the band of larger sets that can still reach the threshold
        band = np.arange(k + 1, end)
        fit = (label[band] != label[k]) & (node[band] != leader[k]) & (leader[band] != node[k])
        band = band[fit & (own[band] != own[k])] if across else band[fit]
        if len(band):
            grid, held = levels[widths[k]], wide[widths[k]]
            own_bits = grid[np.searchsorted(held, k)]
            bound = overlap_bound(n[k], n[band], own_bits, grid[np.searchsorted(held, band)])
            ok = reaches(bound, n[k], n[band], percent)
            band, bound = band[ok], bound[ok]
            if likeliest and len(band):  # of each other label the greatest bound, in parts of the union
                order = np.lexsort((node[band], -bound * 1000 // (n[k] + n[band] - bound), label[band]))
                band = band[order][np.r_[True, np.diff(label[band][order]) != 0]]
                bound = overlap_bound(n[k], n[band], own_bits, grid[np.searchsorted(held, band)])
            found.append(np.stack([
                np.minimum(node[k], node[band]), np.maximum(node[k], node[band]),
                np.minimum(label[k], label[band]), np.maximum(label[k], label[band]),
                -bound * 1000 // (n[k] + n[band] - bound)]))
    a, b, low, high, rank = np.concatenate(found, 1)
    if likeliest and len(a):
        order = np.lexsort((b, a, rank, high, low))
        a, b, low, high = a[order], b[order], low[order], high[order]
        first = np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0)]
        a, b = a[first], b[first]
    return np.stack([a, b])


def tile_pairs(tiles: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int,
               likeliest: bool) -> DataFrame:
    """Pairs of different components that meet in a tile, not yet compared in stars, within the bound."""
    rows = tiles.join(sent_if_small(labels), "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    mixed = rows.groupBy("tile").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
    mixed = settled(mixed.where("low <> high and members > 2").select("tile", "members"))
    rows = rows.join(sent_if_small(mixed), "tile").withColumn(
        "blocks", F.expr(f"int((members - 1) div {BLOCK}) + 1"))
    rows = rows.withColumn("own", F.pmod("node", "blocks").cast("int")).join(
        nodes.select("node", "bits"), "node")
    # A block meets itself and every other one; a tile of up to BLOCK nodes has one block.
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "tile", F.least("own", "other").cast("int").alias("i"),
        F.greatest("own", "other").cast("int").alias("j"), "own", "node", "n", "leader", "label", "bits")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place = [], None

        def closed() -> Iterator[pa.RecordBatch]:
            pairs = meeting(group, percent, likeliest) if len(group) > 1 else np.zeros((2, 0), np.int64)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                columns = batch.slice(k, SLICE).to_pydict()
                for here, *row in zip(
                        zip(columns["tile"], columns["i"], columns["j"], strict=True),
                        *(columns[c] for c in ("own", "node", "n", "leader", "label", "bits")), strict=True):
                    if here != place:
                        yield from closed()
                        group, place = [], here
                    group.append(row)
        yield from closed()

    gathered = rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "n", "node")
    return gathered.mapInArrow(meet, "a long, b long").distinct()


def ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, n, node of each row; node, label of each node with a link)."""
    whole_texts(docs.sparkSession)
    rows = written(described(docs, size, percent, shingle_order(docs, size)))
    release_shuffles(docs.sparkSession)
    firsts = rows.where(F.col("keys").isNotNull())
    tiles = written(shared_tiles(tile_rows(firsts), percent))
    release_shuffles(docs.sparkSession)
    nodes = firsts.select("doc_id", "body", "node", "n", "bits").dropDuplicates(["node"])

    parts = tiles.where("hot").select("tile", "leader").distinct()
    heads = parts.groupBy("tile").agg(F.min("leader").alias("head"))
    stars = settled(ordered(tiles, "node", "leader").union(
        ordered(parts.join(heads, "tile"), "leader", "head")).distinct())
    compared, labels = [stars], None
    pairs = settled(bounded(stars, nodes, percent))
    release_shuffles(docs.sparkSession)
    # The second of the later rounds has all pairs that are left, whatever the first one found.
    for likeliest in (True, False, None):
        if labels is None or not pairs.isEmpty():
            links = verified(pairs, nodes, docs, size, percent)
            if labels is not None:
                links = links.union(labels.select("node", "label"))
            labels = components(links)
            release_shuffles(docs.sparkSession)
        if likeliest is None:
            break
        pairs = tile_pairs(tiles, nodes, labels, percent, likeliest)
        for done in compared:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = settled(pairs)
        release_shuffles(docs.sparkSession)
        compared.append(pairs)
    return rows.select("doc_id", "body", "n", "node"), labels


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, body, n and component_id (the smallest doc_id that links reach) of every row."""
    rows, labels = linked(docs, size, percent)
    ids = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "body", "n",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))


def components_of(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each component, the one with the smallest doc_id.

    Texts without shingles stay. Rows that repeat an id with another text count as other documents.
    """
    found = settled(classes(docs, size, percent).where("n > 0"))
    keys = found.groupBy("doc_id", "body", "component_id").agg(F.count("*").alias("rows"))
    named = keys.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = named.groupBy("component_id").agg(F.min("body").alias("stays"))
    marked = keys.join(least, keys.component_id.eqNullSafe(least.component_id)).drop(least.component_id)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("body") == F.col("stays"))
    return once(without(docs, marked.where(~stays)), marked.where(stays & (F.col("rows") > 1)))
