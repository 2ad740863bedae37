"""Samples: sizes by formula, reproducible, subsets, same as a full ranking."""

import hashlib

import pytest
from pyspark.sql import functions as F

from postlens.operators import counts, sampling

N = {"a": 5000, "q_a": 700, "b": 1250, "q_b": 33}


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(i * 10 + k, p) for k, (p, n) in enumerate(N.items()) for i in range(n)]
    return spark.createDataFrame(rows, "uid long, platform string").repartition(7).cache()


def drawn(posts, sizes, seed=3):
    out = {}
    for r in sampling.sample_uids(posts, sizes, seed).collect():
        out.setdefault(r.platform, set()).add(r.uid)
    return out


def brute(posts, platform, n, seed=3):
    uids = [r.uid for r in posts.where(F.col("platform") == platform).collect()]
    key = lambda u: (hashlib.md5(f"{u}:{seed}".encode()).hexdigest(), u)
    return set(sorted(uids, key=key)[:n])


def test_modes(posts):
    totals = counts.counts_per_platform(posts)
    sizes = lambda frame: {r.platform: r.sample_size for r in frame.collect()}
    assert sizes(sampling.matched_sizes(totals)) == {"a": 700, "b": 33}
    assert sizes(sampling.ratio_sizes(totals, {"a": 1, "b": 5})) == {"a": 50, "b": 60}
    assert sizes(sampling.one_percent_sizes(totals)) == {"a": 50, "q_a": 7, "b": 12, "q_b": 0}
    whole = sum(n ** 0.5 for n in N.values())
    expected = {p: round(n ** 0.5 / whole * 1000) for p, n in N.items()}
    assert sizes(sampling.weighted_sizes(totals, 1000)) == expected


def test_same_as_full_ranking(spark, posts):
    wanted = {"a": 1234, "b": 1, "q_b": 33}
    sizes = spark.createDataFrame(list(wanted.items()), "platform string, sample_size long")
    got = drawn(posts, sizes)
    for platform, n in wanted.items():
        assert got[platform] == brute(posts, platform, n)
    assert drawn(posts.repartition(3), sizes) == got
    assert drawn(posts, sizes, seed=4) != got


def test_more_than_there_is_and_nothing(spark, posts):
    sizes = spark.createDataFrame([("q_b", 1000), ("a", 0), ("none", 5)], "platform string, sample_size long")
    got = drawn(posts, sizes)
    assert {p: len(u) for p, u in got.items()} == {"q_b": 33}
    totals = counts.counts_per_platform(posts)
    assert {r.platform: r.sample_size for r in sampling.drawn_sizes(totals, sizes).collect()} == {"q_b": 33, "a": 0}


def test_head_and_tail_repeats_short_groups(spark):
    rows = spark.createDataFrame([("x", i) for i in range(10)] + [("y", 1), ("y", 2)], "g string, n int")
    got = sampling.head_and_tail(rows, "g", "n", 3).groupBy("g", "n").count().collect()
    assert {(r.g, r.n): r["count"] for r in got} == {
        **{("x", i): 1 for i in (0, 1, 2, 7, 8, 9)}, ("y", 1): 2, ("y", 2): 2}
