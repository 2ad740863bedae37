"""First-wins loads: duplicates inside a batch and against stored rows, stable post ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.numbering import hash_key
from postlens.operators.uid_index import SLOTS, by_key
from postlens.schema import POST_KEY
from postlens.sources.layout import broadcast_if_small, settled

# 56 hash bits leave 7 bits (SLOTS) to tell apart posts whose hashes agree.
HASH_DIGITS = 14


def first_wins(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the remaining columns.

    Rows with a null in the key are left out. The choice is a ``min`` over the whole row, so
    copies of one key shrink to one row per task before the shuffle, however many there are.
    """
    first = [c for c in (order or []) if c not in key]
    rest = [c for c in rows.columns if c not in key and c not in first]
    present = rows
    for column in key:
        present = present.where(F.col(column).isNotNull())
    if not first and not rest:
        return present.distinct()
    best = present.groupBy(*key).agg(F.min(F.struct(*first, *rest)).alias("_row"))
    return best.select(
        *[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns]
    )


def first_wins_stored(
    rows: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """``first_wins`` for a stored table, in which copies are the exception.

    Counting the keys moves only the keys. Rows whose key occurs once then pass without a
    shuffle of their texts; just the others are compared. A few repeated keys are broadcast,
    many are joined.
    """
    present = rows.dropna(subset=key)
    repeated = settled(present.groupBy(*key).count().where("count > 1").select(*key))
    if repeated.isEmpty():
        return present
    known = broadcast_if_small(repeated)
    copies = first_wins(present.join(known, key, "left_semi"), key, order)
    return present.join(known, key, "left_anti").unionByName(copies.select(*present.columns))


def not_stored(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a de-duplicated batch whose key is not stored yet.

    The stored keys meet the keys of the batch only; the (usually few) known ones then go to
    the rows, so no text is shuffled unless a large part of the batch is stored already.
    """
    known = settled(batch.select(*key).join(stored.select(*key), key, "left_semi"))
    return batch.join(broadcast_if_small(known), key, "left_anti")


def append_new(
    stored: DataFrame, batch: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """Stored rows plus the new ones of a batch: running it twice changes nothing."""
    fresh = not_stored(first_wins(batch, key, order), stored, key)
    return stored.unionByName(fresh)


def _hash_bits() -> Column:
    parts = [F.unix_seconds(c) if c == "timestamp" else F.col(c) for c in POST_KEY]
    return F.conv(F.substring(hash_key(*parts), 1, HASH_DIGITS), 16, 10).cast("bigint")


def key_hashes(posts: DataFrame) -> DataFrame:
    """The natural key of each post with its ``hash``."""
    return posts.select(*POST_KEY, _hash_bits().alias("hash"))


def shared_slots(
    keys: DataFrame, taken: DataFrame | None = None, used: DataFrame | None = None
) -> DataFrame | None:
    """(key..., _slot) of the ``key_hashes`` whose slot is not 0, None if there are none.

    Keys with equal hash bits (a handful at any size) get the next free slots of their hash, behind
    those that are stored: ``used(hash, used)`` from an index of the store, or all its ``taken(uid)``.
    """
    keys = keys.withColumnRenamed("hash", "_hash")
    crowd = keys.groupBy("_hash").agg(F.count("*").alias("_posts"))
    if used is not None:
        crowd = crowd.join(
            broadcast_if_small(used.selectExpr("hash as _hash", "used as _used")), "_hash", "left")
    elif taken is not None:
        # Only hashes of the batch matter, so the store is cut down to them before it is grouped.
        stored = taken.select(F.expr(f"uid div {SLOTS}").alias("_hash"), (F.col("uid") % SLOTS).alias("_slot"))
        in_use = stored.join(broadcast_if_small(settled(crowd.select("_hash"))), "_hash", "left_semi") \
            .groupBy("_hash").agg((F.max("_slot") + 1).alias("_used"))
        crowd = crowd.join(in_use, "_hash", "left")
    else:
        crowd = crowd.withColumn("_used", F.lit(None).cast("bigint"))
    crowded = settled(crowd.where("_posts > 1 or _used is not null").drop("_posts"))
    if crowded.isEmpty():
        return None
    place = F.row_number().over(Window.partitionBy("_hash").orderBy(*POST_KEY)) - 1
    return settled(
        keys.join(broadcast_if_small(crowded), "_hash")
        .select(*POST_KEY, (place + F.coalesce("_used", F.lit(0))).alias("_slot"))
        .withColumn("_slot", F.when(F.col("_slot") < SLOTS, F.col("_slot")).otherwise(
            F.raise_error(F.lit("more posts with one hash than slots")))))


def with_slots(posts: DataFrame, slots: DataFrame | None) -> DataFrame:
    """Add ``uid`` from the hash of the key and the ``shared_slots``.

    A key that comes several times has as many slots, one for each of its posts.
    """
    hashed = posts.withColumn("_hash", _hash_bits())
    if slots is None:
        hashed = hashed.withColumn("_slot", F.lit(0).cast("bigint"))
    else:
        own = settled(slots.groupBy(*POST_KEY).agg(F.sort_array(F.collect_list("_slot")).alias("_slots")))
        hashed = by_key(hashed, own, POST_KEY, "left")
        again = F.coalesce(F.size("_slots") > 1, F.lit(False))
        copies = hashed.where(again)
        hashed = hashed.withColumn("_slot", F.coalesce(F.get("_slots", F.lit(0)), F.lit(0)))
        if not own.where("size(_slots) > 1").isEmpty():
            place = F.row_number().over(Window.partitionBy(*POST_KEY).orderBy(*POST_KEY)) - 1
            hashed = hashed.where(~again).unionByName(copies.withColumn("_slot", F.get("_slots", place)))
    return hashed.select(
        (F.col("_hash") * SLOTS + F.col("_slot")).alias("uid"),
        *[c for c in posts.columns if c != "uid"],
    )


def with_uid(
    posts: DataFrame, taken: DataFrame | None = None, used: DataFrame | None = None
) -> DataFrame:
    """Stable positive ``uid`` from the natural key, unique even where hashes agree.

    Only hashes and the keys of posts that share one are shuffled, never the posts themselves.
    """
    return with_slots(posts, shared_slots(key_hashes(posts), taken, used))
