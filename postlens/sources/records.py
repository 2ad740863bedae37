"""CSV files whose records span lines, read by as many tasks as they have splits.

A split starts at any line, maybe inside a quoted field, so whether a line starts a record depends
on all quotes before it. That is settled by a prefix scan over splits, not over lines:

1. Each split is read once and sums up what its quotes do to the state (inside or outside of a
   quoted field). Until its first line with an odd number of quotes it also keeps the lines: they
   end an open record if the split turns out to start inside one.
2. The splits of a file, a few numbers each, are put in order: the state at the start of each
   follows from the sums before it.
3. Each split is read again with its start state. Lines become records; lines that end a record
   of the split before are left to that one, which gets them as its tail.

Tails are what goes to all tasks: one for each split that ends inside a record, at most ``HEAD_BYTES``
long. Files are handled in groups of at most ``GROUP_BYTES``, which bounds all tails together. A file
with a longer rest of a record at the start of a split is read whole by one task instead, and so
are compressed files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.sources.layout import settled

HEAD_BYTES = 1 << 16
GROUP_BYTES = 1 << 42  # 32,768 splits of 128 MB
# What a line does to the state: nothing, toggle it, or end in the outside state whatever it was.
KEEP, TOGGLE, CLOSE = 0, 1, 2
_SPLITS = "name long, block long, first long, last long, closes boolean, parity int, head string"
_RECORDS = "record string, source_file string, leads boolean"


def effect(line: Column, doubled: bool) -> Column:
    """What the quotes of a line do to the state.

    ``doubled``: a quote inside a field is written twice, which toggles twice. Otherwise a backslash
    protects it, and a record starts with a quote: outside of a field, an odd line that does not
    is torn off some record and leaves the state as it is.
    """
    bare = line
    if not doubled:
        bare = F.replace(F.replace(line, F.lit("\\\\")), F.lit('\\"'))
    odd = (F.char_length(bare) - F.char_length(F.replace(bare, F.lit('"')))) % 2 == 1
    toggles = F.lit(True) if doubled else F.startswith(line, F.lit('"'))
    return F.when(~odd, KEEP).when(toggles, TOGGLE).otherwise(CLOSE).cast("int")


def lines(spark: SparkSession, paths: list[str], doubled: bool) -> DataFrame:
    """Lines with their file, split and number; numbers ascend in a split and never change."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        effect(F.col("value"), doubled).alias("effect"))


def _runs(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one split of one file."""
    block = batch.column("block").to_numpy()
    name = batch.column(key).to_numpy()
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (name[1:] != name[:-1])) + 1
    for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


class _Sum:
    """What the lines of a split seen so far do together."""

    def __init__(self, name: int, block: int, first: int):
        self.name, self.block, self.first, self.last = name, block, first, first
        self.closes, self.parity, self.head, self.size, self.ended = False, 0, [], 0, False

    def add(self, run: pa.RecordBatch) -> None:
        effects = run.column("effect").to_numpy()
        closing = np.flatnonzero(effects == CLOSE)
        after = int(np.count_nonzero(effects[closing[-1]:] == TOGGLE)) if len(closing) else 0
        if len(closing):
            self.closes, self.parity = True, after & 1
        else:
            self.parity ^= int(np.count_nonzero(effects == TOGGLE)) & 1
        self.last = run.column("row")[-1].as_py()
        if not self.ended and self.size <= HEAD_BYTES:
            changes = np.flatnonzero(effects != KEEP)
            self.ended = len(changes) > 0
            for value in run.column("value").slice(0, changes[0] + 1 if self.ended else len(run)):
                self.head.append(value.as_py())
                self.size += len(self.head[-1]) + 1
                if self.size > HEAD_BYTES:
                    self.ended = False
                    break

    def row(self) -> list:
        head = "\n".join(self.head) if self.ended else None
        return [self.name, self.block, self.first, self.last, self.closes, self.parity, head]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, own = [], None
    for batch in batches:
        for run in _runs(batch, "name"):
            name, block = run.column("name")[0].as_py(), run.column("block")[0].as_py()
            if own is None or (own.name, own.block) != (name, block):
                done += [own.row()] if own else []
                own = _Sum(name, block, run.column("row")[0].as_py())
            own.add(run)
    done += [own.row()] if own else []
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
    names = [f.split()[0] for f in _SPLITS.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names)


def splits(rows: DataFrame) -> DataFrame:
    """Splits with ``start`` (1 if inside a field) and ``tail`` (what ends the record open at its end)."""
    summed = settled(
        rows.select("value", F.xxhash64("file").alias("name"), "block", "row", "effect")
        .mapInArrow(_sums, _SPLITS))
    order = Window.partitionBy("name").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Behind a split that closes, the state is its parity plus what is summed up after it.
    turned = F.when(F.col("closes"), (F.col("total") + F.col("parity")) % 2)
    return (
        summed.withColumn("total", F.sum("parity").over(order))
        .withColumn("base", F.coalesce(F.last(turned, ignorenulls=True).over(before), F.lit(0)))
        .withColumn("start", (F.col("base") + F.col("total") - F.col("parity")) % 2)
        .withColumn("next", F.lead("start").over(order))
        .withColumn("follower", F.lead("head").over(order))
        .withColumn("tail", F.when(F.col("next") == 1, F.col("follower"))))


class _Assembler:
    """Records from the runs of lines of one task."""

    def __init__(self):
        self.split, self.state, self.open, self.tail, self.leads = None, 0, [], None, False
        self.out: list[tuple[pa.Array, str, bool]] = []

    def add(self, run: pa.RecordBatch) -> None:
        split = run.column("file")[0].as_py(), run.column("block")[0].as_py()
        values, effects = run.column("value"), run.column("effect").to_numpy()
        if split != self.split:
            self.end()
            self.split, self.leads = split, split[1] == 0
            self.state = run.column("start")[0].as_py() or 0
        toggles = np.cumsum(effects == TOGGLE)
        closing = np.maximum.accumulate(np.where(effects == CLOSE, np.arange(len(run)), -1))
        after = np.where(closing < 0, self.state + toggles, toggles - toggles[closing]) & 1
        starts = np.flatnonzero(np.concatenate([[self.state], after[:-1]]) == 0)
        self.state, self.tail = int(after[-1]), run.column("tail")[-1].as_py()
        if self.open:
            self.open.append(values.slice(0, starts[0] if len(starts) else len(run)))
        if not len(starts):
            return
        self.flush()
        edges = np.append(starts, len(run)) if not self.state else starts
        if self.state:
            self.open = [values.slice(starts[-1])]
        if len(edges) > 1:
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
            self.emit(pc.binary_join(lists, "\n"))

    def emit(self, records: pa.Array) -> None:
        if self.leads:
            self.out += [(records.slice(0, 1), self.split[0], True), (records.slice(1), self.split[0], False)]
        else:
            self.out.append((records, self.split[0], False))
        self.leads = False

    def flush(self) -> None:
        if self.open:
            texts = [v for part in self.open for v in part.to_pylist()]
            self.open = []
            self.emit(pa.array(["\n".join(texts)]))

    def end(self) -> None:
        if self.open and self.tail is not None:
            self.open.append(pa.array([self.tail]))
        self.flush()

    def rows(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        for records, file, leads in out:
            if len(records):
                yield pa.RecordBatch.from_arrays(
                    [records, pa.array([file] * len(records)), pa.array([leads] * len(records))],
                    ["record", "source_file", "leads"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _Assembler()
    for batch in batches:
        for run in _runs_by_file(batch):
            state.add(run)
        yield from state.rows()
    state.end()
    yield from state.rows()


def _runs_by_file(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = pc.dictionary_encode(batch.column("file")).indices
    for run in _runs(batch.append_column("name", names), "name"):
        yield run


def read_records(spark: SparkSession, paths: list[str], doubled: bool) -> tuple[DataFrame, DataFrame]:
    """(record, source_file, leads) of plain files, and the files that a single task has to read.

    ``leads`` marks the first record of a file. Records are the text between line breaks outside of
    quoted fields; empty ones are left out, and so is a carriage return at their end.
    """
    rows = lines(spark, paths, doubled)
    found = settled(splits(rows))
    # A split that starts inside a record whose end it does not show within bounds.
    whole = found.where("start = 1 and head is null").select("name").distinct()
    marks = (
        found.where("start = 1").selectExpr("first as row", "start", "cast(null as string) as tail")
        .unionByName(found.where("tail is not null").selectExpr("last as row", "cast(null as int) as start", "tail"))
        .groupBy("row").agg(F.max("start").cast("int").alias("start"), F.max("tail").alias("tail")))
    # Two rows a split at most, with HEAD_BYTES at most; see GROUP_BYTES.
    marked = rows.join(F.broadcast(settled(marks)), "row", "left")
    records = marked.select("value", "file", "block", "effect", "start", "tail").mapInArrow(
        _assemble, _RECORDS)
    record = F.rtrim(F.col("record"), F.lit("\r"))
    kept = records.withColumn("record", record).where(F.trim("record") != "")
    return kept.join(F.broadcast(whole), F.xxhash64("source_file") == F.col("name"), "left_anti"), whole


def sized_groups(files: list[tuple[str, int]]) -> list[list[str]]:
    """Files in groups of at most GROUP_BYTES, or of one file."""
    groups, size = [], GROUP_BYTES
    for path, length in sorted(files):
        if size + length > GROUP_BYTES or not groups:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += length
    return groups


def read_split_csv(
    spark: SparkSession, files: list[tuple[str, int]], schema: str, options: dict, header: bool = False
) -> DataFrame:
    """Columns of ``schema`` and ``source_file`` of plain CSV files given as (path, length)."""
    doubled = options["escape"] == '"'
    parts = []
    for paths in sized_groups(files):
        records, whole = read_records(spark, paths, doubled)
        if header:
            records = records.where(~F.col("leads"))
        # Unpacked by a generator: a filter on the fields then cannot repeat the parsing.
        parts.append(records.select(
            F.inline(F.array(F.from_csv("record", schema, options))), "source_file"))
        names = {r.name for r in whole.collect()}  # files, seldom any
        if names:
            listed = spark.read.schema(schema).options(**options).option("multiLine", True).csv(
                paths, header=header).withColumn("source_file", F.col("_metadata.file_path"))
            parts.append(listed.where(F.xxhash64("source_file").isin(*names)))
    return reduce(DataFrame.unionByName, parts)
