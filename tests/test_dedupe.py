"""First-wins loads, hot keys, stable ids with colliding hashes, distributed numbering."""

import pytest
from pyspark.sql import functions as F

from postlens.catalog import registry
from postlens.operators import dedupe, dimensions, numbering, uid_index
from postlens.schema import POST_KEY


def frame(spark, rows):
    return spark.createDataFrame(rows, "platform string, board string, post_type string, post_id string, "
                                 "epoch long, author string, rank int").select(
        "platform", "board", "post_type", "post_id", F.timestamp_seconds("epoch").alias("timestamp"),
        "author", "rank")


def test_first_wins_and_nulls(spark):
    rows = [("p", "b", "comment", "1", 5, "late", 2), ("p", "b", "comment", "1", 5, "early", 1),
            ("p", "b", "comment", "1", 6, "other time", 2), ("p", None, "comment", "1", 5, "no board", 1)]
    got = dedupe.first_wins(frame(spark, rows), POST_KEY, ["rank"])
    assert sorted(r.author for r in got.collect()) == ["early", "other time"]


def test_hot_key_shrinks_before_the_shuffle(spark):
    rows = spark.range(0, 30_000, 1, 8).selectExpr(
        "'p' as platform", "'b' as board", "'comment' as post_type",
        "cast(if(id % 3 = 0, 0, id) as string) as post_id", "timestamp_seconds(1) as timestamp", "id as n")
    got = dedupe.first_wins(rows, POST_KEY, ["n"])
    assert got.count() == 20_001
    assert got.where("post_id = '0'").first().n == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_stored_rows_with_few_and_many_copies(spark, monkeypatch):
    rows = frame(spark, [("p", "b", "comment", str(i % 40), 5, f"a{i}", i) for i in range(100)])
    rows = rows.unionByName(frame(spark, [("p", "b", "comment", None, 5, "x", 1)]))
    expected = sorted(dedupe.first_wins(rows, POST_KEY, ["rank"]).collect())
    assert sorted(dedupe.first_wins_stored(rows, POST_KEY, ["rank"]).collect()) == expected
    monkeypatch.setattr(dedupe, "broadcast_if_small", lambda frame: frame)
    assert sorted(dedupe.first_wins_stored(rows, POST_KEY, ["rank"]).collect()) == expected
    single = rows.where("rank < 40").dropna()
    assert dedupe.first_wins_stored(single, POST_KEY).count() == 40


def test_append_is_idempotent(spark):
    batch = frame(spark, [("p", "b", "comment", str(i % 5), 5, f"a{i}", i) for i in range(10)])
    empty = batch.limit(0)
    once = dedupe.append_new(empty, batch, POST_KEY, ["rank"])
    twice = dedupe.append_new(once, batch, POST_KEY, ["rank"])
    assert once.count() == 5 and sorted(once.collect()) == sorted(twice.collect())


def test_uids_with_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "HASH_DIGITS", 1)  # 16 hashes for 300 posts
    rows = frame(spark, [("p", "b", "comment", str(i), 5, "a", i) for i in range(300)])
    first = dedupe.with_uid(rows.where("rank < 150"))
    assert first.select("uid").distinct().count() == 150
    second = dedupe.with_uid(rows.where("rank >= 150"), first.select("uid"))
    both = first.unionByName(second)
    assert both.select("uid").distinct().count() == 300
    assert both.where("uid < 0").count() == 0
    again = dedupe.with_uid(rows.where("rank < 150").repartition(5))
    assert sorted(again.select("uid", "post_id").collect()) == sorted(first.select("uid", "post_id").collect())


def test_numbering_is_dense(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as g").withColumn("key", numbering.hash_key(F.col("id")))
    got = numbering.number_rows(rows, "key", ["id"], ["g"], "n").collect()
    for g in range(3):
        mine = sorted((r.n, r.key) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [k for _, k in mine] == sorted(k for _, k in mine)


def test_dimension_keeps_ids(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    none = spark.createDataFrame([], "uid long, name string")
    first = dimensions.extend_dimension(none, names("x", "y", "x", "it's"))
    ids = {r.name: r.uid for r in first.collect()}
    assert sorted(ids.values()) == [1, 2, 3]
    second = {r.name: r.uid for r in dimensions.extend_dimension(first, names("z", "x", None)).collect()}
    assert second == {**ids, "z": 4}


@pytest.fixture()
def index(spark, tmp_path):
    return uid_index.UidIndex(spark, str(tmp_path / "index"), 4)


def test_filter_knows_every_hash_and_few_others(spark, index):
    uids = spark.range(20_000).selectExpr("xxhash64(id) div 256 * 128 as uid").where("uid > 0")
    index.add(uids)
    index.add(uids.selectExpr("uid + 1280 as uid").limit(300))  # a second load, with filters of another size
    assert index.filters().select("bitmaps").distinct().count() == 2
    own = uids.selectExpr("uid div 128 as hash").distinct()
    assert index.maybe_stored(own).count() == own.count()
    others = spark.range(40_000).selectExpr("xxhash64(id, 7) div 256 as hash").where("hash > 0")
    assert index.maybe_stored(others).count() < 0.01 * others.count()
    assert index.used(others).count() == 0


def test_index_gives_the_slots_of_the_store(spark, index, monkeypatch):
    monkeypatch.setattr(dedupe, "HASH_DIGITS", 1)  # 16 hashes for 300 posts
    rows = frame(spark, [("p", "b", "comment", str(i), 5, "a", i) for i in range(300)])
    parts = [rows.where(f"rank % 3 = {k}") for k in range(3)]
    stored = None
    for part in parts:
        keys = dedupe.key_hashes(part)
        used = index.used(keys)
        by_index = dedupe.with_uid(part, used=used).select("uid", "post_id")
        by_scan = dedupe.with_uid(part, stored.select("uid") if stored is not None else None).select("uid", "post_id")
        assert sorted(by_index.collect()) == sorted(by_scan.collect())
        new = dedupe.with_uid(part, used=used)
        stored = new if stored is None else stored.unionByName(new)
        index.add(new.select("uid"))
    assert stored.select("uid").distinct().count() == 300
    assert index.uids().count() == 300


def test_stored_side_is_not_shuffled(spark, index):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index.add(spark.range(1, 5_000).selectExpr("id * 128 as uid"))
        asked = spark.range(1, 9_000).selectExpr("id as hash")
        joined = index.uids().join(asked, "hash").groupBy("hash").agg(F.max("slot"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
        assert joined.count() == 4_999
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_keys_read_no_stored_key(spark, index):
    """The stored posts may only be read for keys whose hash is stored."""
    rows = frame(spark, [("p", "b", "comment", str(i), 5, "a", i) for i in range(200)])
    index.add(dedupe.with_uid(rows.where("rank < 100")).select("uid"))
    unreadable = rows.withColumn("month", F.raise_error(F.lit("the store was read")))
    new = dedupe.key_hashes(rows.where("rank >= 100"))
    assert uid_index.known_keys(new, index.used(new), unreadable, POST_KEY).count() == 0
    stored = rows.where("rank < 100").withColumn("month", F.lit("1970-01"))
    both = dedupe.key_hashes(rows)
    assert uid_index.known_keys(both, index.used(both), stored, POST_KEY).count() == 100


def test_ids_of_repeated_keys_and_of_keys_with_nulls(spark, monkeypatch):
    rows = frame(spark, [("p", "b", "comment", "1", 5, "a", 1)] * 3 + [("p", "b", "comment", None, 5, "a", 1)] * 2
                 + [("p", "b", "comment", str(i), 5, "a", i) for i in range(2, 40)])
    for digits in (14, 1):
        monkeypatch.setattr(dedupe, "HASH_DIGITS", digits)
        got = dedupe.with_uid(rows)
        assert got.count() == 43 and got.select("uid").distinct().count() == 43


def test_index_knows_keys_with_nulls(spark, index):
    rows = frame(spark, [("p", "b", "comment", None, 5, "a", 1), ("p", "b", None, "1", None, "a", 1),
                         ("p", "b", "comment", "2", 5, "a", 1)])
    index.add(dedupe.with_uid(rows).select("uid"))
    keys = dedupe.key_hashes(rows.unionByName(frame(spark, [("q", "b", "comment", None, 5, "a", 1)])))
    stored = rows.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    known = uid_index.known_keys(keys, index.used(keys), stored, POST_KEY)
    assert known.count() == 3


def test_surrogate_key_index_over_two_loads(spark, tmp_path):
    """Rows with repeated keys and without an id: every row once, every id once."""
    docs = [(i // 2 if i < 20 else i, f"t{i}", ["en", "fr", "de", "es"][i // 2 % 4], "s", 2) for i in range(100)]
    docs += [(None, "x", lang, "s", 1) for lang in ("en", "fr", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = registry.surrogate_key_index(spark, str(tmp_path))
    assert got.count() == 103 and got.select("uid").distinct().count() == 103
    assert sorted(got.collect(), key=str) == sorted(registry.surrogate_key(spark, str(tmp_path)).collect(), key=str)
