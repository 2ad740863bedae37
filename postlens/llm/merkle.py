"""Merkle manifest of a dataset with incremental witnesses.

Leaves are appended in order to a tree of arity 8. A run of siblings is open until its eighth node
arrives: a node that joins it gets a partial witness with the siblings to its left, and each later
sibling that completes extends the witnesses of those before it. A leaf shares the steps of its
ancestors, so an append costs a few strings however many leaves a subtree has.

Aligned blocks of 8 ** 4 leaves are appended by different tasks. The roots of the blocks are then
appended in the same way, as the leaves of the next round, until a group has one root; the roots
of the groups form the last tree. Steps found above a block are sent down to it once and complete
the witnesses of all its leaves. A task holds one block; only the numbers of leaves reach the driver.

A group is a language; null is a language of its own and comes first. In a group, leaves ascend by
doc_id, null first, then by their own hash; equal rows are leaves of their own, whose places are
interchangeable. Null fields are `-`, empty ones `0:`. An empty table gives no row. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.store import sent_if_small, settled, written

ARITY = 8
# A block has ARITY ** LEVELS leaves and is built by one task.
LEVELS = 4
BLOCK = ARITY ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "grp string, pos long, height int, digest string"
_STEPS = "grp string, block long, lefts array<string>, rights array<string>"


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@dataclass
class Step:
    """Siblings of one node: those on its left, and those on its right as they complete."""

    digest: str
    first: int
    left: str
    right: list[str] = field(default_factory=list)

    def sides(self) -> tuple[str, str]:
        return self.left, "".join(self.right)


class Appender:
    """A subtree of a given height that leaves are appended to."""

    def __init__(self, height: int):
        self.height, self.leaves, self.root = height, 0, ""
        self.open: list[list[Step]] = [[] for _ in range(height)]
        self.witnesses: list[list[Step]] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self.leaves += 1
        self._complete(0, digest, self.leaves - 1)

    def _complete(self, level: int, digest: str, first: int) -> None:
        if level == self.height:
            self.root = digest
            return
        run = self.open[level]
        for sibling in run:
            sibling.right.append(digest)
        step = Step(digest, first, "".join(s.digest for s in run))
        for leaf in range(first, self.leaves):
            self.witnesses[leaf].append(step)
        run.append(step)
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._complete(level + 1, hashed("".join(s.digest for s in run)), run[0].first)

    def finish(self) -> str:
        """Close the open runs, which have fewer nodes, and return the root."""
        for level in range(self.height):
            if self.open[level]:
                self._close(level)
        return self.root


def appended(block: pd.DataFrame) -> Appender:
    """The rows (place, height, digest) of one block, in order."""
    block = block.sort_values("place")
    tree = Appender(int(block["height"].iloc[0]))
    for digest in block["digest"]:
        tree.append(digest)
    tree.finish()
    return tree


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        digest = hashed(left + digest + right)
    return digest


def encoded(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


# --- places ----------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its ``grp``, and ``size``, the rows of the group.

    Rows are range-partitioned over all groups, so that a group of any size is spread; a place is
    the rows of the group in earlier partitions plus the rank in the own one. Rows that are equal
    in all of ``order`` are told apart by ``row``, so that many of them are spread as well.
    """
    keys = ["grp", *order, "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    cut = written(ranged.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = settled(
        cut.groupBy("grp", "part").agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
        .withColumn("size", F.sum("n").over(Window.partitionBy("grp"))).drop("n"))
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "row")) - 1
    return (
        cut.withColumn("inside", inside).join(sent_if_small(sizes), ["grp", "part"])
        .withColumn("pos", (F.col("start") + F.col("inside")).cast("long"))
        .drop("row", "part", "inside", "start"))


def tree_height() -> Column:
    """Levels above ``size`` nodes until one remains."""
    reach = F.lit(0)
    for level in range(20, -1, -1):  # 8 ** 21 is beyond a long
        reach = F.when(F.col("size") <= F.lit(ARITY ** level), F.lit(level)).otherwise(
            F.lit(21) if level == 20 else reach)
    return reach.cast("int")


# --- rounds of blocks ------------------------------------------------------------


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Rows with the block they are in, their place there and the height of the block."""
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn(
        "place", (F.col("pos") % BLOCK).cast("int")).withColumn(
        "rest", F.greatest(F.col("height") - LEVELS, F.lit(0))).withColumn(
        "height", F.least("height", F.lit(LEVELS)))


def _roots(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    root = appended(block).root
    return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "height": block["rest"].iloc[:1].to_list(), "digest": [root]})


def block_roots(nodes: DataFrame) -> DataFrame:
    """The nodes of the next round: one for each block."""
    blocks = _in_blocks(nodes).select("grp", "block", "place", "height", "rest", "digest")
    return blocks.groupBy("grp", "block").applyInPandas(_roots, _NODES)


def _descend(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    tree, (lefts, rights) = appended(block), _above(above)
    block = block.sort_values("place")
    sides = [[s.sides() for s in steps] for steps in tree.witnesses]
    return pd.DataFrame({
        "grp": block["grp"].to_list(), "block": block["pos"].to_list(),
        "lefts": [[s[0] for s in own] + lefts for own in sides],
        "rights": [[s[1] for s in own] + rights for own in sides]})


def _above(above: pd.DataFrame) -> tuple[list[str], list[str]]:
    return (list(above["lefts"].iloc[0]), list(above["rights"].iloc[0])) if len(above) else ([], [])


def descended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The steps of every node of a round, for the blocks below: its own and those above its block."""
    blocks = _in_blocks(nodes).select("grp", "block", "pos", "place", "height", "digest")
    return blocks.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(_descend, _STEPS)


def rounds(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Nodes (grp, pos, height, digest) of each round; the last has one for each group."""
    out = [leaves.select("grp", "pos", "height", "digest")]
    while largest > 1:
        out.append(settled(block_roots(out[-1])))
        largest = -(-largest // BLOCK)
    return out


_RESULT = ("doc_id long, lang string, pos long, leaf string, subroot string, proof_sha256 string, "
           "folded_root string")


def _proved(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    tree, (lefts, rights) = appended(block), _above(above)
    block = block.sort_values("place")
    upper = list(zip(lefts, rights, strict=True))
    end = "".join(left + right for left, right in upper)
    proofs, folded = [], []
    for steps, other in zip(tree.witnesses, block["other"], strict=True):
        own = [s.sides() for s in steps]
        proofs.append(hashed("".join(left + right for left, right in own) + end))
        folded.append(fold(other, own + upper))
    out = block[["doc_id", "lang", "pos", "subroot"]].copy()
    out["leaf"], out["proof_sha256"], out["folded_root"] = block["digest"], proofs, folded
    return out[["doc_id", "lang", "pos", "leaf", "subroot", "proof_sha256", "folded_root"]]


def manifest(docs: DataFrame, other_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang, pos, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the hash of all siblings from the leaf to the root. ``folded_root`` is the root
    that these siblings give for the document with ``other_text`` as its text (default: its own);
    ``verified`` tells whether it is the root.
    """
    values = [F.col(c).cast("string" if c in ("source", "lang", "text") else "long") for c in FIELDS]
    leaf = leaf_hash(values)
    changed = leaf_hash([*values[:-1], other_text]) if other_text is not None else leaf
    leaves = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        leaf.alias("digest"), F.nullif(changed, leaf).alias("other")))
    leaves = settled(numbered(leaves, ["doc_id", "digest"]).withColumn("height", tree_height()))
    largest = leaves.agg(F.max("size")).first()[0] or 0

    # The first round has the leaves; a group of one leaf is its own root.
    trees = rounds(leaves, largest)
    tops = settled(trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"))
    tops = settled(numbered(tops, ["name"]).withColumn("height", tree_height()))
    groups = tops.count()
    upper = rounds(tops, groups)
    last = upper[-1].select("digest").first()  # one node is left
    root = F.lit(last.digest if last else None).cast("string")

    spark = docs.sparkSession
    steps = spark.createDataFrame([], _STEPS)
    for nodes in reversed(upper[:-1]):
        steps = settled(descended(nodes, steps))
    # A group's steps now belong to the only block of its last round.
    names = tops.select("name", F.col("pos").alias("at"))
    if len(upper) > 1:
        steps = names.join(steps, F.col("at") == F.col("block")).select(
            F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "lefts", "rights")
    else:
        steps = names.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"),
                             F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    for nodes in reversed(trees[1:-1]):
        steps = descended(nodes, steps)
    steps = settled(steps)

    subroots = settled(tops.select(F.col("name").alias("grp"), F.col("digest").alias("subroot")))
    # One group of blocks a task at most, so the subroots are few beside the leaves.
    blocks = _in_blocks(leaves.join(sent_if_small(subroots), "grp")).select(
        "grp", "block", "pos", "place", "height", "digest", "doc_id", "lang", "subroot",
        F.coalesce("other", "digest").alias("other"))
    proved = blocks.groupBy("grp", "block").cogroup(steps.groupBy("grp", "block")).applyInPandas(_proved, _RESULT)
    return proved.select(
        "doc_id", "lang", "pos", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def tampered_text() -> Column:
    """The text with A-Z lower-cased where 3 divides the checksum of the id, else as it is."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    return F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
