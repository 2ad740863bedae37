"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

A window of the text has as many words as the benchmark item it is compared with. The fingerprint
of a window or item is a 128-bit SimHash of its five-word shingles. The second, third... occurrence of
a shingle in the window is a feature of its own, so that fingerprints see sets whose Jaccard similarity
is the weighted one, and a shingle that repeats does not move all bits together. Fingerprints are cut into 16 blocks: two within the radius agree in some block up to one or
two bits, so a table per block finds them all. Found pairs are verified by the exact weighted
Jaccard similarity of their shingles. Windows that share no shingle with any item of their size
have similarity 0; they are not fingerprinted.

The benchmark is the stated query set: it is read in blocks of ``ITEM_BLOCK`` items, which bounds
what goes to a task, and each block meets all documents. Words are runs of letters and digits
without regard to case, so punctuation does not hide a passage. An item of fewer than five words is
one shingle; an item without words matches nothing. A text shorter than an item is one window.
Null and empty texts are clean. Repeated items each count; repeated rows get equal results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import whole_texts
from postlens.llm.words import Texts, chunks, mix, shingles

SHINGLE = 5
SIMILARITY = 0.8
ITEM_BLOCK = 4096
# Windows that are fingerprinted at a time.
WINDOWS = 1024
BITS, BLOCKS = 128, 16
# 8 blocks within 2 bits and 8 within 1: 8 * 3 + 8 * 2 = 40 > 39, so no pair is missed.
RADIUS, BLOCK_RADIUS = 39, np.array([2, 1] * 8)
# Expected distance at similarity 0.8 is 19.4 bits with deviation 4.1.

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = texts._spans(_ALNUM[texts.buffer])
    return texts.hashes(starts, ends, lower=True), row


def signs(features: np.ndarray) -> np.ndarray:
    """+1 or -1 for each feature and bit."""
    words = np.stack([mix(features ^ np.uint64(0x1234567)), mix(features ^ np.uint64(0x7654321))], 1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def numbered(features: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The ``times``-th occurrence of each feature, as a feature; the first one is itself."""
    return np.where(times == 1, features, mix(features + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def fingerprints(features: np.ndarray, first: int, last: int, length: int) -> np.ndarray:
    """SimHash blocks of the windows of ``length`` features that start at ``first`` to ``last``.

    An occurrence is the k-th of its feature in the windows that start behind its k-th last one and
    not behind its (k - 1)-th last one: a range of windows, which gets the signs of the numbered feature.
    """
    own = features[first: last + length]
    count = last - first + 1
    change = np.zeros((count + 1, BITS), np.int32)
    # Earlier occurrence of the same feature, or -1.
    order = np.argsort(own, kind="stable")
    before = np.full(len(own), -1)
    same = own[order[1:]] == own[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at, high, times = np.arange(len(own)), np.arange(len(own)), 1
    while len(at):
        low = before[high]  # windows behind it have one occurrence less
        begin = np.maximum(np.maximum(low, at - length) + 1, 0)
        end = np.minimum(high, count - 1)
        some = begin <= end
        if some.any():
            add = signs(numbered(own[at[some]], np.full(int(some.sum()), times)))
            np.add.at(change, begin[some], add)
            np.subtract.at(change, end[some] + 1, add)
        more = low > at - length
        more &= low >= 0
        at, high, times = at[more], low[more], times + 1
    return np.packbits(np.cumsum(change[:-1], axis=0) > 0, axis=1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two lists of features, each counted as often as it occurs."""
    both, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca = np.bincount(which[: len(a)], minlength=len(both))
    cb = np.bincount(which[len(a):], minlength=len(both))
    top = np.maximum(ca, cb).sum()
    return float(np.minimum(ca, cb).sum() / top) if top else 0.0


class Items:
    """Items of one size: words, shingle length, fingerprints and the block tables."""

    def __init__(self, words: int, ids: list[int], features: list[np.ndarray]):
        self.words, self.size = words, min(SHINGLE, words)
        self.length = words - self.size + 1
        self.ids, self.features = ids, features
        self.blocks = np.stack([fingerprints(f, 0, 0, self.length)[0] for f in features])
        values = np.arange(256, dtype=np.uint8)
        self.near = np.stack([  # [block, value, item]
            _ONES[values[:, None] ^ self.blocks[None, :, k]] <= BLOCK_RADIUS[k]
            for k in range(BLOCKS)])

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius."""
        found = np.zeros((len(prints), len(self.ids)), bool)
        for k in range(BLOCKS):
            found |= self.near[k][prints[:, k]]
        window, item = np.nonzero(found)
        close = _ONES[prints[window] ^ self.blocks[item]].sum(1) <= RADIUS
        return window[close], item[close]


class Index:
    """A block of the benchmark: its items by size, and which sizes each shingle occurs in."""

    def __init__(self, rows: list[tuple[int, str]]):
        grouped = defaultdict(lambda: ([], []))
        for piece in chunks(pa.array([t for _, t in rows], pa.string())):
            hashes, row = word_hashes(piece)
            for k in range(piece.rows):
                own = hashes[row == k]
                if len(own):
                    size = min(SHINGLE, len(own))
                    ids, features = grouped[len(own)]
                    ids.append(rows[piece.first + k][0])
                    features.append(shingles(own, np.zeros(len(own), int), size)[0])
        self.sizes = [Items(n, *grouped[n]) for n in sorted(grouped)]
        self.seeds = {}  # shingle length -> sorted features, index of the size of each
        for size in {s.size for s in self.sizes}:
            pairs = sorted({(int(f), k) for k, s in enumerate(self.sizes) if s.size == size
                            for own in s.features for f in own})
            seeds = np.array([f for f, _ in pairs], np.uint64)
            filled = np.zeros(1 << 20, bool)
            filled[seeds >> np.uint64(44)] = True
            self.seeds[size] = seeds, np.array([k for _, k in pairs]), filled

    def search(self, texts: Texts) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of the best window of each matching pair."""
        hashes, row = word_hashes(texts)
        bounds = np.searchsorted(row, np.arange(texts.rows + 1))
        for size, (seeds, owner, filled) in self.seeds.items():
            feature, at = shingles(hashes, row, size)
            hits = np.flatnonzero(filled[feature >> np.uint64(44)])
            low = np.searchsorted(seeds, feature[hits], "left")
            high = np.searchsorted(seeds, feature[hits], "right")
            hits, low, high = hits[high > low], low[high > low], high[high > low]
            near = defaultdict(list)  # (text, size of items) -> positions of seeds
            for h, a, b in zip(hits, low, high, strict=True):
                for k in owner[a:b]:
                    near[int(row[at[h]]), int(k)].append(int(at[h]))
            for (text, k), positions in near.items():
                yield from self._compare(text, self.sizes[k], hashes[bounds[text]: bounds[text + 1]],
                                         np.array(positions) - bounds[text])

    def _compare(self, text: int, items: Items, words: np.ndarray, seeds: np.ndarray):
        features, _ = shingles(words, np.zeros(len(words), int), items.size)
        length = min(items.length, len(features))
        top = len(features) - length  # windows that hold a seed, as ranges of starts
        covered = np.zeros(top + 2, np.int64)
        np.add.at(covered, np.minimum(np.maximum(seeds - length + 1, 0), top), 1)
        np.subtract.at(covered, np.minimum(seeds, top) + 1, 1)
        starts = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        best: dict[int, tuple[float, int]] = {}
        for low in range(0, len(starts), WINDOWS):  # runs of near windows
            part = starts[low: low + WINDOWS]
            for run in np.split(part, np.flatnonzero(np.diff(part) > length) + 1):
                prints = fingerprints(features, int(run[0]), int(run[-1]), length)[run - run[0]]
                for w, i in zip(*items.within(prints), strict=True):
                    s = int(run[w])
                    likeness = weighted_jaccard(features[s: s + length], items.features[i])
                    if likeness >= SIMILARITY and (likeness, -s) > best.get(i, (0.0, 0)):
                        best[i] = likeness, -s
        for i, (likeness, s) in best.items():
            yield text, items.ids[i], -s, likeness


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, body, item_id, word, similarity of every benchmark item found in a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, body long, item_id long, word long, similarity double"
    spark, parts, block = docs.sparkSession, [], []
    whole_texts(spark)

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in batches:
                for piece in chunks(batch.column("text")):
                    found = list(index.search(piece))
                    at = pa.array([piece.first + f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("body").take(at),
                         *(pa.array([f[k] for f in found], t) for k, t in
                           ((1, pa.int64()), (2, pa.int64()), (3, pa.float64())))],
                        ["doc_id", "body", "item_id", "word", "similarity"])
        return rows.mapInArrow(search, schema)

    for item in items.toLocalIterator():  # one partition at a time; never all items at once
        block.append((item.item_id, item.text))
        if len(block) == ITEM_BLOCK:
            parts.append(searched(block))
            block = []
    if block or not parts:
        parts.append(searched(block))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contaminated(found: DataFrame) -> DataFrame:
    """doc_id, body, items (sorted), similarity (the best) of each document with a match."""
    return found.groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (null if clean) and similarity of each document."""
    found = contaminated(matches(docs, benchmark)).select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "items", "similarity")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"))
    joined = own.join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    return joined.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), "items", "similarity")
