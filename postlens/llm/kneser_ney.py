"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model of trusted text.

All words of the trusted texts are counted; words in none of them share what the discounts leave to
the uniform distribution. A word is its 64-bit hash; the ``FREQUENT`` most frequent have short numbers
instead, which only saves bytes. Bigrams are counted over all trusted texts, in shards of their first
word; c(u .), N(u .) and N(. w) come from the shards, too. Documents never meet the model as a whole: a
task turns its texts into blocks of sorted bigram requests with the places that asked, each request
goes to its shard, is answered there from the counts, and returns as sums per document. So the model
and what is shuffled grow with the corpus, while a task holds one shard and one request at a time.
A slice of the shards is asked at a time, by all documents, and its shuffle files are gone before the next:
the disk holds one part of the model and of the requests, and no part of the model is shuffled twice.

A request asks only the shard of its first word. Of log p(w | u), the part of an unseen bigram that
depends on w is log lower(w); a text opens and closes with the same border, so its words are as often
first as second in a bigram, and the shard adds log lower(u) instead. Seen bigrams carry N(. w).

The trusted texts are dealt into two folds by content, and every document, trusted or not, is
scored by the model of the other fold: so no text is judged by counts of its own, trusted and new
texts compare, and all trusted text is counted.

Texts labelled toxic are counted in two folds of their own in the same way. A toxic document is mostly
ordinary text, so the alternative to the trusted model is a mixture: a share ``TOXIC_SHARE`` of the words
comes from the toxic texts, by continuation probabilities. A document whose log-likelihood ratio of the
mixture is positive and above a quantile of the trusted documents (which neither fold has read) is not
kept. A word met once only in the toxic fold counts as not met: the ratio of rare words is noise.

Otherwise a document is kept if its smoothed mean log-probability is not below a quantile of the trusted
documents of its language (of all languages where it has fewer than ``LEAST_TRUSTED`` of them).

Null, empty and blank texts have no perplexity and are not kept. Without trusted text nothing can
be judged: all documents with words are kept. Repeated rows get equal results; labels may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.store import sent_if_small, settled, shuffles_dropped, whole_texts, written
from postlens.llm.words import Texts, chunks, mix

FREQUENT = 65_000  # words with a 16-bit number; the others are known by their hashes
LEADING = 17  # bits of a hash that a frequent word is looked up by
UNKNOWN, EDGE, FIRST = 0, 1, 2  # numbers of words outside a limited vocabulary, borders and the first word
ESCAPE = 65_535
HASHED = np.uint64(1 << 63)  # set in the hash of a word without a number
SHARD_BITS = 6
SHARDS = 1 << SHARD_BITS
BLOCK_WORDS, BLOCK_TEXTS = 2_500_000, 60_000
MERGE_KEYS = 2_000_000
QUANTILE = 0.005
TOXIC_QUANTILE, TOXIC_SHARE = 0.995, 0.001
FOLDS = 4  # trusted 0 and 1, toxic 2 and 3
SMOOTHING_WORDS = 25.0
LEAST_TRUSTED = 100
SLICES = 4  # of the shards


def by_fold(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    fold = batch.column("fold").to_numpy()
    for f in range(FOLDS):
        own = batch.filter(pa.array(fold == f))
        if own.num_rows:
            yield f, own


def among(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


@dataclass
class Vocabulary:
    """How words are named: sorted hashes of the frequent ones, and of all allowed ones of each fold if limited."""

    frequent: np.ndarray
    allowed: list[np.ndarray] | None
    starts: np.ndarray = field(init=False)  # where the hashes with each leading bits start in ``frequent``

    def __post_init__(self):
        self.starts = np.searchsorted(self.frequent, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING))

    def placed(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``among`` the frequent ones, of which few share their leading bits."""
        table = np.append(self.frequent, np.uint64(2**64 - 1))
        at = self.starts[hashes >> np.uint64(64 - LEADING)]
        behind = np.flatnonzero(table[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[table[at[behind]] < hashes[behind]]
        return at, (table[at] == hashes) & (at < len(self.frequent))

    def numbered(self, texts: Texts, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and text of every word."""
        starts, ends, row = texts.words()
        hashes = texts.hashes(starts, ends, lower=True)
        at, short = self.placed(hashes)
        ids = np.where(short, (at + FIRST).astype(np.uint64), hashes | HASHED)
        if self.allowed is not None:
            ids[~among(hashes, self.allowed[fold % 2])[1]] = UNKNOWN
        return ids, row


def bigrams(ids: np.ndarray, row: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, second word and text of every bigram, borders included."""
    filled = np.bincount(row, minlength=texts) > 0
    ends = np.searchsorted(row, np.flatnonzero(filled), "right")
    padded = np.insert(ids, ends, np.uint64(EDGE))  # one border after each text with words
    rows = np.insert(row, ends, np.flatnonzero(filled))
    before = np.roll(padded, 1)  # the last is a border
    return before, padded, rows


def shard_of(ids: np.ndarray) -> np.ndarray:
    """Shards are ranges of mixed ids: what is sorted by ``mix`` has them one after another."""
    return (mix(ids) >> np.uint64(64 - SHARD_BITS)).astype(np.int32)


def slice_of(shard):
    """The slice of a shard, as of a column of them."""
    return shard * SLICES // SHARDS


def sorted_pairs(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of bigrams by mixed first word and second word, and where each distinct one starts."""
    order = np.lexsort((w, mix(u)))
    u, w = u[order], w[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    return order, np.flatnonzero(new)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(values)])


def _pack(values: np.ndarray) -> bytes:
    """The bytes of each significance lie together, which compresses better."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(dtype)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Short numbers in two bytes, hashes apart in eight."""
    hashed = ids >= HASHED
    short = _pack(np.where(hashed, np.uint64(ESCAPE), ids).astype(np.uint16))
    return len(short).to_bytes(8, "little") + short + _pack(ids[hashed])


def _unpack_ids(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    ids = _unpack(data[8:end], np.uint16).astype(np.uint64)
    ids[ids == ESCAPE] = _unpack(data[end:], np.uint64)
    return ids


def _pack_pairs(u: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """First words, how many bigrams each has, and second words of sorted distinct bigrams."""
    first, length = runs(u)
    return _pack_ids(u[first]), _pack(length.astype(np.uint32)), _pack_ids(w)


def _unpack_pairs(heads: bytes, lengths: bytes, seconds: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(_unpack_ids(heads), _unpack(lengths, np.uint32)), _unpack_ids(seconds)


class Tally:
    """Counts of keys in bounded memory: pieces are merged as they pile up."""

    def __init__(self, dtype):
        self.keys, self.counts = np.zeros(0, dtype), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.pending.append((keys, counts))
        self.size += len(keys)
        if self.size > MERGE_KEYS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.pending:
            keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
            counts = np.concatenate([self.counts, *(c for _, c in self.pending)])
            self.keys, at = np.unique(keys, return_inverse=True)
            self.counts = np.bincount(at, counts, len(self.keys)).astype(np.int64)
            self.pending, self.size = [], 0
        return self.keys, self.counts


class Pairs:
    """Counts of bigrams in bounded memory, sorted once merged."""

    def __init__(self):
        self.u, self.w, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
        self.pending.append((u, w, n))
        self.size += len(u)
        if self.size > MERGE_KEYS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.pending:
            u, w, n = (np.concatenate(x) for x in zip((self.u, self.w, self.n), *self.pending, strict=True))
            self.pending, self.size = [], 0
            order, first = sorted_pairs(u, w)
            self.u, self.w = u[order[first]], w[order[first]]
            self.n = np.add.reduceat(n[order], first) if len(first) else n[:0]
        return self.u, self.w, self.n


def vocabulary_of(trusted: DataFrame, size: int | None) -> tuple[Vocabulary, list[tuple[int, int]]]:
    """How words are named, and the number of words with and without a name of their own in each fold."""
    def rows(fold: int, tally: Tally) -> pa.RecordBatch:
        keys, counts = tally.merge()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), fold, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
            ["fold", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Tally(np.uint64) for _ in range(FOLDS)]
        for batch in batches:
            for fold, own in by_fold(batch):
                for piece in chunks(own.column("text")):
                    starts, ends, _ = piece.words()
                    tallies[fold].add(piece.hashes(starts, ends, lower=True))
                if len(tallies[fold].keys) > 2 * MERGE_KEYS:
                    yield rows(fold, tallies[fold])
                    tallies[fold] = Tally(np.uint64)
        for fold, tally in enumerate(tallies):
            yield rows(fold, tally)

    counted = written(trusted.select("fold", "text").mapInArrow(count, "fold int, word long, n long").groupBy(
        "fold", "word").agg(F.sum("n").alias("n")))

    def top(words: DataFrame, most: int) -> np.ndarray:
        table = words.orderBy(F.col("n").desc(), "word").limit(most).select("word").toArrow()
        return np.sort(table["word"].to_numpy().view(np.uint64))

    kinds = {r.fold: r.kinds for r in counted.groupBy("fold").agg(F.count("*").alias("kinds")).collect()}
    frequent = top(counted.groupBy("word").agg(F.sum("n").alias("n")), FREQUENT)
    allowed = None if size is None else [top(counted.where(F.col("fold") == fold), size) for fold in (0, 1)]
    named = [kinds.get(f, 0) if allowed is None else len(allowed[f % 2]) for f in range(FOLDS)]
    return Vocabulary(frequent, allowed), [(named[f], kinds.get(f, 0) - named[f]) for f in range(FOLDS)]


PAIRS = "shard int, heads binary, lengths binary, seconds binary, counts binary"


def counted_bigrams(trusted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """PAIRS: one row for each shard (one of each fold for each range of first words)."""
    sent = trusted.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(fold: int, tally: Pairs) -> Iterator[pa.RecordBatch]:
        u, w, n = tally.merge()
        bounds = np.searchsorted(shard_of(u), np.arange(SHARDS + 1))
        for k in range(SHARDS):
            own = slice(bounds[k], bounds[k + 1])
            if own.start < own.stop:
                yield packed(FOLDS * k + fold, u[own], w[own], n[own])

    def packed(shard: int, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), *(pa.array([x]) for x in (*_pack_pairs(u, w), _pack(n)))],
            ["shard", "heads", "lengths", "seconds", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [Pairs() for _ in range(FOLDS)]
        for batch in batches:
            for fold, own in by_fold(batch):
                for piece in chunks(own.column("text")):
                    u, w, _ = bigrams(*sent.value.numbered(piece, fold), piece.rows)
                    tallies[fold].add(u, w, np.ones(len(u), np.int64))
                if len(tallies[fold].u) > 2 * MERGE_KEYS:
                    yield from rows(fold, tallies[fold])
                    tallies[fold] = Pairs()
        for fold, tally in enumerate(tallies):
            yield from rows(fold, tally)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tally = None, Pairs()
        for batch in batches:
            for shard, heads, lengths, seconds, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != place:
                    if place is not None:
                        yield packed(place, *tally.merge())
                    place, tally = shard, Pairs()
                tally.add(*_unpack_pairs(heads, lengths, seconds), _unpack(counts, np.int64))
        if place is not None:
            yield packed(place, *tally.merge())

    partial = trusted.select("fold", "text").mapInArrow(count, PAIRS)
    # Partitions follow the size: a task merges its shards one by one, small ones share a task and a file.
    return written(partial.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, PAIRS))


OWN, ASKED = 1, 2


def continuations(counted: DataFrame) -> DataFrame:
    """shard, kind, words, kinds: N(. w) of the words of each shard (OWN) and of the second words of its bigrams.

    The bigrams of a shard send their second words to the shards of those, which add up and send back.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, seconds in zip(batch.column("shard").to_pylist(), batch.column("seconds").to_pylist(),
                                       strict=True):
                words, kinds = np.unique(_unpack_ids(seconds), return_counts=True)
                shard = shard_of(words)
                for k in np.unique(shard):
                    own = shard == k
                    yield row(FOLDS * int(k) + source % FOLDS, source, words[own], kinds[own])

    def row(shard: int, other: int, words: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([other], pa.int32()), pa.array([_pack_ids(words)]),
             pa.array([_pack(kinds.astype(np.int64))])], ["shard", "kind", "words", "kinds"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pieces = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if pieces:
                words, at = np.unique(np.concatenate([w for _, w, _ in pieces]), return_inverse=True)
                kinds = np.bincount(at, np.concatenate([n for _, _, n in pieces]), len(words))
                yield row(place, OWN, words, kinds)
                for source, asked, _ in pieces:
                    yield row(source, ASKED, asked, kinds[np.searchsorted(words, asked)])

        for batch in batches:
            for shard, source, words, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != place:
                    yield from closed()
                    place, pieces = shard, []
                pieces.append((source, _unpack_ids(words), _unpack(kinds, np.int64)))
        yield from closed()

    schema = "shard int, kind int, words binary, kinds binary"
    return written(counted.mapInArrow(send, schema).repartition("shard").sortWithinPartitions(
        "shard").mapInArrow(add, schema))


def discounts(ones: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = ones
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    out = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.clip(out, 0.0, [0.0, 1.0, 2.0, 3.0])


@dataclass
class Model:
    """What every task needs besides the sharded counts: a few numbers."""

    cuts: np.ndarray  # discounts of bigrams
    low: np.ndarray  # discounts of N(. w)
    spread: float  # what each word gets of the discounted N(. w)
    pairs: float  # number of distinct bigrams
    unknown_log: float  # log of the number of words that UNKNOWN stands for

    def lower(self, kinds: np.ndarray) -> np.ndarray:
        """Continuation probability of words with the given N(. w)."""
        return np.maximum((np.maximum(kinds - self.low[np.minimum(kinds, 3)], 0) + self.spread)
                          / max(1.0, self.pairs), 1e-12)


class Shard:
    """The counts of a shard, ready to answer."""

    def __init__(self, model: Model, pairs: tuple[bytes, bytes, bytes, bytes] | None,
                 own: tuple[bytes, bytes] | None, asked: list[tuple[bytes, bytes]]):
        self.model = model
        self.words, self.kinds = (_unpack_ids(own[0]), _unpack(own[1], np.int64)) if own else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64))  # sorted
        self.heads, self.left, self.keys, self.gain = np.zeros(0, np.uint64), *np.zeros((1, 0)), self.words[:0], np.zeros(0)
        if pairs is None:
            return
        u, w = _unpack_pairs(*pairs[:3])
        counts = _unpack(pairs[3], np.int64)
        first, length = runs(u)
        totals = np.add.reduceat(counts, first)
        left = np.maximum(np.add.reduceat(model.cuts[np.minimum(counts, 3)], first) / totals, 1e-9)
        seconds = np.concatenate([_unpack_ids(x) for x, _ in asked])
        order = np.argsort(seconds)
        kinds = np.concatenate([_unpack(n, np.int64) for _, n in asked])[order]
        lower = model.lower(kinds[np.searchsorted(seconds[order], w)])
        high = np.maximum(counts - model.cuts[np.minimum(counts, 3)], 0) / np.repeat(totals, length)
        gain = np.log(high + np.repeat(left, length) * lower) - np.log(lower)
        keys = self.key(u, w)
        order = np.argsort(keys)
        self.keys, self.gain = keys[order], gain[order]
        order = np.argsort(u[first])
        self.heads, self.left = u[first][order], np.log(left[order])

    def kinds_of(self, words: np.ndarray) -> np.ndarray:
        at, known = among(words, self.words)
        kinds = np.zeros(len(words), np.int64)
        kinds[known] = self.kinds[at[known]]
        return kinds

    def mixed(self, toxic: Shard, words: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word with a share of toxic words to the trusted model alone."""
        kinds = toxic.kinds_of(words)
        ratio = np.where(kinds > 1, toxic.model.lower(kinds) / self.model.lower(self.kinds_of(words)), 0.0)
        return np.log1p(TOXIC_SHARE * (ratio - 1))

    @staticmethod
    def key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return mix(mix(u) + mix(w ^ np.uint64(0x5851F42D4C957F2D)))

    def logs(self, heads: np.ndarray, lengths: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log p(w | u) - log lower(w) + log lower(u) of bigrams, by first words and their numbers of bigrams."""
        at, known = among(heads, self.heads)
        left = np.zeros(len(heads))
        left[known] = self.left[at[known]]
        base = np.log(self.model.lower(self.kinds_of(heads))) - np.where(heads == UNKNOWN, self.model.unknown_log, 0.0)
        logs = np.repeat(left, lengths)
        at, seen = among(self.key(np.repeat(heads, lengths), w), self.keys)
        logs[seen] = self.gain[at[seen]]
        return logs + np.repeat(base, lengths)


def model_of(counted: DataFrame, continued: DataFrame, words: int, others: int, fold: int) -> Model:
    """The few numbers of a fold from its sharded counts."""
    def describe(column: str):
        def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.zeros(6, np.int64)
                for data in batch.column(column).to_pylist():
                    found += np.bincount(np.minimum(_unpack(data, np.int64), 5), minlength=6)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(6, dtype=np.int32)), pa.array(found)], ["k", "n"])
        return ones

    def summed(rows: DataFrame, column: str) -> list[float]:
        table = rows.where(F.col("shard") % FOLDS == fold).select(column).mapInArrow(
            describe(column), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        found = {r.k: float(r.n) for r in table}
        return [found.get(k, 0.0) for k in range(1, 6)]

    ones, kinds = summed(counted, "counts"), summed(continued.where(F.col("kind") == OWN), "kinds")
    low = discounts(kinds[:4])
    spread = low[1] * kinds[0] + low[2] * kinds[1] + low[3] * sum(kinds[2:])
    return Model(discounts(ones[:4]), low, spread / (words + FIRST), sum(ones), float(np.log(max(1, others))))


PAIR, WORDS, SECONDS, TOXIC, REQUEST, PLACES = 0, OWN, ASKED, 3, 4, 5  # TOXIC: words of the toxic fold
ROUTED = ("shard int, kind int, block long, heads binary, lengths binary, seconds binary, counts binary, "
          "places binary, card binary")
BLOBS = ["heads", "lengths", "seconds", "counts", "places", "card"]
CARD = ["doc_id", "body", "language"]


def _routed(shard: int, kind: int, block: int, *parts: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()),
         *(pa.array([p], pa.binary()) for p in parts)], ROUTED.replace(",", "").split()[::2])


class Asked:
    """A block of texts of one fold in the making, with their bigrams of one slice of the shards."""

    def __init__(self, fold: int, number: int, part: int):
        self.fold, self.number, self.part = fold, number, part
        self.u, self.w, self.places, self.cards = [], [], [], []
        self.texts = self.words = 0

    def full(self, more: int) -> bool:
        return bool(self.cards) and (self.words > BLOCK_WORDS or self.texts + more > BLOCK_TEXTS)

    def add(self, texts: Texts, own: pa.RecordBatch, vocabulary: Vocabulary) -> None:
        ids, row = vocabulary.numbered(texts, 1 - self.fold)
        u, w, places = bigrams(ids, row, texts.rows)
        mine = np.flatnonzero(slice_of(shard_of(u)) == self.part)
        self.u.append(u[mine])
        self.w.append(w[mine])
        self.places.append((places[mine] + self.texts).astype(np.uint16))
        self.cards.append(own.append_column("n_words", pa.array(np.bincount(row, minlength=texts.rows))).append_column(
            "events", pa.array(np.bincount(places, minlength=texts.rows))))
        self.texts, self.words = self.texts + texts.rows, self.words + len(mine)

    def rows(self) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * (1 << 24) + 2 * self.number + self.fold
        u, w, place = np.concatenate(self.u), np.concatenate(self.w), np.concatenate(self.places)
        self.u, self.w, self.places = [], [], []
        card = pa.Table.from_batches(self.cards).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, card.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(card)
        yield _routed(block % (2 * SHARDS), PLACES, block, *[None] * 5, sink.getvalue().to_pybytes())
        order, first = sorted_pairs(u, w)
        u, w, place = u[order[first]], w[order[first]], place[order]  # places of a bigram stay in order
        times = np.diff(np.r_[first, len(place)])
        first = np.r_[first, len(place)]
        bounds = np.searchsorted(shard_of(u), np.arange(SHARDS + 1))
        for k in range(SHARDS):
            low, high = bounds[k], bounds[k + 1]
            if low < high:
                own = place[first[low]: first[high]]
                yield _routed(2 * k + 1 - self.fold, REQUEST, block, *_pack_pairs(u[low:high], w[low:high]),
                              _pack(times[low:high].astype(np.uint32)), _pack(np.diff(own, prepend=np.uint16(0))), None)


def scored(rows: DataFrame, vocabulary: Vocabulary, counted: DataFrame, continued: DataFrame,
           models: list[Model], part: int) -> DataFrame:
    """doc_id, body, language, n_words, events of every row (columns as CARD, fold, text), log and toxic_ratio of a slice."""
    context = rows.sparkSession.sparkContext
    sent, known = context.broadcast(models), context.broadcast(vocabulary)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Asked(0, 0, part), Asked(1, 0, part)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TEXTS):
                for fold, own in by_fold(batch.slice(at, BLOCK_TEXTS)):
                    for piece in chunks(own.column("text")):
                        if asked[fold].full(piece.rows):
                            yield from asked[fold].rows()
                            asked[fold] = Asked(fold, asked[fold].number + 1, part)
                        asked[fold].add(piece, own.slice(piece.first, piece.rows).select(CARD), known.value)
        for block in asked:
            if block.cards:
                yield from block.rows()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard, toxic, parts = None, None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["shard"] != place:
                    place, shard, toxic, parts = row["shard"], None, None, [None, None, [], None]
                if row["kind"] == PAIR:
                    parts[PAIR] = row["heads"], row["lengths"], row["seconds"], row["counts"]
                elif row["kind"] in (WORDS, TOXIC):
                    parts[row["kind"]] = row["heads"], row["counts"]
                elif row["kind"] == SECONDS:
                    parts[SECONDS].append((row["heads"], row["counts"]))
                elif row["kind"] == PLACES:
                    yield _answered(row["block"], None, row["card"])
                else:
                    if shard is None:
                        shard = Shard(sent.value[place % 2], *parts[:TOXIC])
                        toxic, parts = Shard(sent.value[2 + place % 2], None, parts[TOXIC], []), None
                    heads, lengths = _unpack_ids(row["heads"]), _unpack(row["lengths"], np.uint32)
                    at = np.cumsum(_unpack(row["places"], np.uint16), dtype=np.uint16)
                    times = _unpack(row["counts"], np.uint32)
                    sums = [np.bincount(at, np.repeat(shard.logs(heads, lengths, _unpack_ids(row["seconds"])), times))]
                    if toxic.model.pairs:
                        sums.append(np.bincount(at, np.repeat(np.repeat(shard.mixed(toxic, heads), lengths), times)))
                    else:
                        sums.append(np.full(len(sums[0]), np.nan))
                    yield _answered(row["block"], _pack(np.concatenate(sums).astype(np.float32)), None)

    def _answered(block: int, sums: bytes | None, card: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([sums], pa.binary()), pa.array([card], pa.binary())],
            ["block", "sums", "card"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, card, total = None, None, np.zeros((2, 0))

        def closed() -> Iterator[pa.RecordBatch]:
            if card is not None:
                logs = np.zeros((2, card.num_rows))
                logs[:, : total.shape[1]] += total
                out = card.append_column("log", pa.array(logs[0])).append_column(
                    "toxic_ratio", pa.array(logs[1], from_pandas=True))  # NaN without toxic text: null
                yield from out.combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            for block, sums, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != place:
                    yield from closed()
                    place, card, total = block, None, np.zeros((2, 0))
                if data is not None:
                    card = pa.ipc.open_stream(data).read_all()
                else:
                    part = _unpack(sums, np.float32).astype(float).reshape(2, -1)
                    if part.shape[1] > total.shape[1]:
                        total = np.pad(total, ((0, 0), (0, part.shape[1] - total.shape[1])))
                    total[:, : part.shape[1]] += part
        yield from closed()

    def routed(table: DataFrame, **columns) -> DataFrame:
        filled = {"block": F.lit(None)} | {c: F.lit(None) for c in BLOBS} | columns
        shard = F.expr(f"int(shard div {FOLDS} * 2 + shard % 2)")
        return table.select(shard.alias("shard"), filled.pop("kind").alias("kind"),
                            filled.pop("block").cast("long").alias("block"),
                            *(filled[c].cast("binary").alias(c) for c in BLOBS))

    asked = rows.mapInArrow(ask, ROUTED)
    trusted = F.col("shard") % FOLDS < 2
    mine = F.expr(f"shard div {FOLDS} * {SLICES} div {SHARDS} = {part}")
    shards = routed(counted.where(mine & trusted), kind=F.lit(PAIR), **{c: F.col(c) for c in BLOBS[:4]}).unionByName(routed(
        continued.where(mine & (trusted | (F.col("kind") == OWN))), kind=F.when(trusted, F.col("kind")).otherwise(TOXIC),
        heads=F.col("words"), counts=F.col("kinds")))
    answers = shards.unionByName(asked).repartition(2 * SHARDS, "shard").sortWithinPartitions(
        "shard", "kind").mapInArrow(answer, "block long, sums binary, card binary")
    return answers.repartition("block").sortWithinPartitions("block").mapInArrow(
        add, "doc_id long, body long, language string, n_words long, events long, log double, toxic_ratio double")


def added(parts: list[DataFrame]) -> DataFrame:
    """The rows of all slices as one row for each document: ``log`` and ``toxic_ratio`` are added up.

    Repeated documents are equal in every slice, so one of them stands for all, and comes out as often.
    """
    rows = parts[0].withColumn("part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("part", F.lit(k)))

    def total(name: str) -> Column:
        return reduce(Column.__add__, [F.max(F.when(F.col("part") == k, F.col(name))) for k in range(len(parts))])

    found = rows.groupBy(*CARD, "n_words", "events").agg(
        total("log").alias("log"), total("toxic_ratio").alias("toxic_ratio"),
        F.expr(f"count(*) div {len(parts)}").alias("copies"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")


def perplexities(docs: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, body, language, trusted, n_words, events, log, toxic_ratio of every document (the last null without toxic text).

    With ``size``, only so many words of each fold have counts of their own; all have by default.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    good = F.expr("quality = 1 and coalesce(toxic, 0) = 0")
    judged = sent_if_small(settled(labels.where(good | (F.col("toxic") == 1)).where("doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.coalesce(good, F.lit(False))).alias("_good"))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"),
        F.col("lang").cast("string").alias("language"), F.expr("int(xxhash64(text) & 1)").alias("fold"),
        F.col("text").cast("string").alias("text"))
    trusted = rows.join(judged, F.col("doc_id") == F.col("_id")).select(
        F.expr("fold + if(_good, 0, 2)").alias("fold"), "text")
    with shuffles_dropped(spark):
        vocabulary, known = vocabulary_of(trusted, size)
        counted = counted_bigrams(trusted, vocabulary)
        continued = continuations(counted)
        models = [model_of(counted, continued, *known[fold], fold) for fold in range(FOLDS)]
        parts = [written(scored(rows, vocabulary, counted, continued, models, k)) for k in range(SLICES)]
    return added(parts).join(judged, F.col("doc_id") == F.col("_id"), "left").select(
        *CARD, F.coalesce("_good", F.lit(False)).alias("trusted"), "n_words", "events", "log", "toxic_ratio")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, language, n_words, perplexity, score, threshold and kept of every document."""
    rows = settled(perplexities(docs, labels))
    known = rows.where("trusted and events > 0").withColumn(
        "language", F.coalesce("language", F.lit("")))
    means = sent_if_small(settled(known.groupBy("language").agg(
        (F.sum("log") / F.sum("events")).alias("mean"))))
    overall = known.agg((F.sum("log") / F.sum("events")).alias("mean")).first().mean

    def smoothed(part: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(overall if overall is not None else 0.0))
        return part.join(means, F.coalesce(part.language, F.lit("")) == means.language, "left").drop(
            means.language).withColumn("score", F.when(
                F.col("events") > 0, (F.col("log") + SMOOTHING_WORDS * mean) / (F.col("events") + SMOOTHING_WORDS)))

    judged = smoothed(rows).drop("mean")
    sure = judged.where("trusted and events > 0")
    everywhere = sure.agg(F.percentile_approx("score", quantile, 10_000).alias("q")).first().q
    limits = sent_if_small(settled(sure.groupBy(F.coalesce("language", F.lit("")).alias("_language")).agg(
        F.percentile_approx("score", quantile, 10_000).alias("q"), F.count("*").alias("_n")).where(
        F.col("_n") >= LEAST_TRUSTED).drop("_n")))
    most = sure.agg(F.percentile_approx("toxic_ratio", TOXIC_QUANTILE, 10_000).alias("q")).first().q
    toxic = F.coalesce(F.col("toxic_ratio") > F.lit(max(most or 0.0, 0.0)), F.lit(False))
    limit = F.coalesce("q", F.lit(everywhere if everywhere is not None else -1e9))
    return judged.join(limits, F.coalesce("language", F.lit("")) == F.col("_language"), "left").select(
        "doc_id", "language", "n_words",
        F.when(F.col("events") > 0, F.exp(-F.col("log") / F.col("events"))).alias("perplexity"), "score",
        limit.alias("threshold"), (F.coalesce(F.col("score") >= limit, F.lit(False)) & ~toxic).alias("kept"))
