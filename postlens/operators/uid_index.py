"""Which key hashes are stored, so that a load does not read the stored posts.

Two tables beside the posts, extended by each load:

``uids_<n>``  (hash, slot) of every stored post, in n buckets by hash. Hashes of a batch are dealt to
the same buckets, so the stored side is never shuffled.
``filter``  a Bloom filter of the hashes for each load: 4 bits of one bitmap of 32,768 bits for a hash,
16 bits in all or more. About 1 in 400 new hashes passes; only such hashes and known ones meet ``uids``.

A key with a new hash is a new key and gets slot 0. Only keys whose hash is stored are compared with
stored posts, in the months of these keys.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.sinks.tables import exists
from postlens.sources.layout import broadcast_if_small, settled, together

# Uids are hash * SLOTS + slot.
SLOTS = 128
# Buckets of a new index: about 100 million stored posts each is a sensible size.
BUCKETS = 16
BITMAP, BITS_PER_KEY, PROBES = 32_768, 16, 4
FILTER_SCHEMA = "bitmaps long, bitmap long, bits binary"


class UidIndex:
    """The index in a folder; nothing is read or written before it is asked."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    # --- tables ------------------------------------------------------------------

    def _table(self) -> str:
        """Name of the bucketed table; its files are declared to the session's catalog once."""
        path = f"{self.folder}/uids_{self.buckets}"
        name = f"uids_{md5(path.encode()).hexdigest()}"
        self.spark.sql(
            f"create table if not exists {name} (hash long, slot int) using parquet "
            f"clustered by (hash) sorted by (hash) into {self.buckets} buckets location '{path}'")
        self.spark.catalog.refreshTable(name)  # another session may have added files
        return name

    def uids(self) -> DataFrame:
        return self.spark.table(self._table())

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTER_SCHEMA).parquet(f"{self.folder}/filter")

    def is_empty(self) -> bool:
        return not exists(self.spark, f"{self.folder}/filter")

    # --- asking --------------------------------------------------------------------

    def maybe_stored(self, hashes: DataFrame) -> DataFrame:
        """``hashes(hash)`` that the filters do not rule out."""
        filters = self.filters()
        sizes = [F.lit(r.bitmaps) for r in filters.select("bitmaps").distinct().collect()]  # powers of two
        probes = hashes.select("hash", F.explode(F.array(*sizes)).alias("bitmaps")).withColumn(
            "bitmap", _bitmap(F.col("hash"), F.col("bitmaps")))
        bit = " and ".join(_is_set(k) for k in range(PROBES))
        return probes.join(filters, ["bitmaps", "bitmap"]).where(bit).select("hash").distinct()

    def used(self, hashes: DataFrame) -> DataFrame:
        """(hash, used): the slots behind those in use, for each of ``hashes(hash)`` that is stored."""
        none = self.spark.createDataFrame([], "hash long, used long")
        if self.is_empty():
            return none
        maybe = settled(self.maybe_stored(hashes))
        if maybe.isEmpty():
            return none
        return settled(
            self.uids().join(maybe, "hash")
            .groupBy("hash").agg((F.max("slot") + 1).cast("long").alias("used")))

    # --- extending -----------------------------------------------------------------

    def add(self, uids: DataFrame) -> None:
        """Add ``uids(uid)`` of new posts."""
        rows = uids.select(F.expr(f"uid div {SLOTS}").alias("hash"), (F.col("uid") % SLOTS).cast("int").alias("slot"))
        n = rows.count()
        if not n:
            return
        bitmaps = 1 << max(0, -(-n * BITS_PER_KEY // BITMAP) - 1).bit_length()
        name = self._table()
        places = rows.select(
            _bitmap(F.col("hash"), F.lit(bitmaps)).alias("bitmap"),
            F.explode(F.array(*[_place(k) for k in range(PROBES)])).alias("place"))
        bits = places.groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits")).select(
            F.lit(bitmaps).cast("long").alias("bitmaps"), "bitmap", "bits")
        together(
            lambda: rows.repartition(self.buckets, "hash").write.insertInto(name),
            lambda: bits.write.mode("append").parquet(f"{self.folder}/filter"))
        self.spark.catalog.refreshTable(name)


def _bitmap(key: Column, bitmaps: Column) -> Column:
    return F.pmod(F.xxhash64(key), bitmaps).cast("long")


def _place(probe: int) -> Column:
    return F.pmod(F.xxhash64(F.col("hash"), F.lit(probe)), F.lit(BITMAP)).cast("long")


def _is_set(probe: int) -> str:
    """SQL: is the bit of ``hash`` set in ``bits``? Bits of a byte count from the lowest."""
    place = f"pmod(xxhash64(hash, {probe}), {BITMAP})"
    byte = f"cast(conv(hex(substring(bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    return f"bit_get({byte}, cast({place} % 8 as int)) = 1"


def known_keys(keys: DataFrame, used: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Of ``keys(hash, key...)`` those that are stored; ``stored`` is read only for stored hashes."""
    asked = settled(keys.join(broadcast_if_small(used.select("hash")), "hash", "left_semi").select(*key))
    if asked.isEmpty():
        return asked
    span = asked.agg(F.date_format(F.min("timestamp"), "yyyy-MM").alias("low"),
                     F.date_format(F.max("timestamp"), "yyyy-MM").alias("high")).first()
    within = stored.where(F.col("month").between(span.low, span.high) | F.col("month").isNull())
    return settled(by_key(within.select(*key), asked, key, "left_semi").distinct())


def by_key(rows: DataFrame, others: DataFrame, key: list[str], how: str) -> DataFrame:
    """Join settled ``others`` to ``rows`` by a key in which nulls are equal."""
    named = others.withColumnsRenamed({c: f"_key_{c}" for c in key})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key))
    return rows.join(broadcast_if_small(named), same, how).drop(*[f"_key_{c}" for c in key])
