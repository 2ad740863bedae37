"""The whole analysis job on a small table, read back from its outputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import report, rollups
from postlens.plans.analyse import analyse
from postlens.sinks import tables
from postlens.sources.layout import stored
from postlens.sources.markers import any_of, atom, marker_table

BODIES = ["red pill", "Red, red pill!", "blue", None, "the RED car", "pill red"]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.range(0, 1200, 1, 5).selectExpr(
        "id as uid", "cast(id as string) as post_id", "timestamp_seconds(1509134400 + id * 7200) as timestamp",
        "cast(null as string) as thread_id", "cast(null as bigint) as thread_uid",
        "cast(null as string) as parent_id", "cast(null as bigint) as parent_uid",
        "'it\"s, me' as author", "'subject red' as subject",
        f"element_at(array({', '.join('null' if b is None else repr(b) for b in BODIES)}), cast(id % 6 + 1 as int)) as body",
        "cast(null as string) as extras", "concat('b', id % 4) as board",
        "element_at(array('4chan','4chan','reddit','q_4chan','4chan'), cast(id % 5 + 1 as int)) as platform",
        "'comment' as post_type")


MARKERS = [
    ("m1", "4chan", "c1", "t1", "x", "g1", "red", 1, [any_of(atom("term", "red"))]),
    ("m2", "4chan", "c1", "t2", "x", "g2", '"red pill"', 1, [any_of(atom("phrase", "red", "pill"))]),
    ("m3", "reddit", "c2", "t1", "x", "g1", "nothing", 1, [any_of(atom("term", "nothing"))]),
    ("m4", "elsewhere", "c2", "t1", "x", "g1", "red", 1, [any_of(atom("term", "red"))]),
    ("m5", "4chan", "c2", "t1", "x", "g1", "broken", 1, []),
    ("m6", "4chan", "c2", "t1", "x", "g1", "off", 0, [any_of(atom("term", "red"))]),
]


def lines(spark, path):
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def expected(platform, word):
    """(posts, spans) by plain counting."""
    platforms = ["4chan", "4chan", "reddit", "q_4chan", "4chan"]
    hits = [BODIES[i % 6].lower().replace(",", "").count(word) for i in range(1200)
            if platforms[i % 5] == platform and BODIES[i % 6]]
    return sum(h > 0 for h in hits), sum(hits)


@pytest.fixture(scope="module")
def done(spark, posts, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    table = marker_table(spark, MARKERS)
    result = analyse(spark, posts, table, out, mode="weighted", total=100, seed=1)
    return out, {r["index"]: r for r in result.collect()}, table


def test_report(spark, posts, done):
    out, rows, table = done
    assert set(rows) == {"m1", "m2", "m3", "m4", "m5"}
    for index, word in (("m1", "red"), ("m2", "red pill")):
        count, spans = expected("4chan", word)
        assert (rows[index].count_all, rows[index].match_all) == (count, spans)
        assert rows[index].count_all_rel == f"{count / 720:.10f}"
        assert rows[index].match_all_ratio == pytest.approx(spans / count)
        assert (rows[index].count_qanon, rows[index].match_qanon) == expected("q_4chan", word)
        assert 0 < rows[index].count_sample <= rows[index].count_all
    assert rows["m3"].count_all == 0 and rows["m3"].match_all_ratio == -1
    assert rows["m3"].count_qanon_rel == "-1"  # no posts of that reference dataset
    assert rows["m4"].count_all == 0 and rows["m4"].count_all_rel == "-1"
    assert rows["m5"].count_all == -1 and rows["m5"].count_sample_rel == "-1"
    dry = analyse(spark, posts, table, "/nowhere", mode="weighted", total=100, seed=1, dryrun=True)
    assert {r["index"]: r for r in dry.collect()} == rows


def test_outputs(spark, done):
    out, rows, _ = done
    sizes = {r["platform"]: r["sample_size"] for r in lines(spark, f"{out}/meta/sample_size")}
    assert set(sizes) == {"4chan", "reddit"}
    uids = spark.read.json(f"{out}/sample").groupBy("platform").count().collect()
    assert {r.platform: r["count"] for r in uids} == sizes
    assert len(lines(spark, f"{out}/sample_full_json")) == sum(sizes.values())
    full = spark.read.option("header", True).option("escape", '"').csv(f"{out}/sample_full_csv")
    assert full.count() == sum(sizes.values()) and full.first().author == 'it"s, me'
    platform_counts = {r["platform"]: r["count_posts"] for r in lines(spark, f"{out}/meta/counts_per_platform")}
    assert platform_counts == {"4chan": 720, "reddit": 240, "q_4chan": 240,
                               **{f"sample_{p}": n for p, n in sizes.items()}}
    days = lines(spark, f"{out}/meta/distribution_per_date")
    assert sum(d["count_4chan"] for d in days) == 720
    assert sum(d["count_sample_reddit"] for d in days) == sizes["reddit"]
    csv = {r["index"]: r for r in spark.read.option("header", True).option("escape", '"').csv(f"{out}/analysis_csv").collect()}
    assert csv["m2"].fts_query == '"red pill"' and csv["m1"].count_all == str(rows["m1"].count_all)
    listed = spark.read.json(f"{out}/analysis_uids").select("index", "scope", F.explode("uids").alias("uid"))
    sums = {(r["index"], r.scope): r["count"] for r in listed.groupBy("index", "scope").count().collect()}
    assert sums[("m1", "all")] == rows["m1"].count_all and sums[("m2", "sample")] == rows["m2"].count_sample
    comments = spark.read.json(f"{out}/comments").where("index = 'm2'").collect()
    assert len(comments) == rows["m2"].count_all + rows["m2"].count_qanon
    assert {c.body for c in comments} == {
        '<span class="fts_match">red pill</span>', 'Red, <span class="fts_match">red pill</span>!'}
    category = {(r["platform"], r["category"]): r for r in lines(spark, f"{out}/rollups/category")}
    assert category[("4chan", "c1")]["count_all"] == rows["m1"].count_all + rows["m2"].count_all
    assert category[("4chan", "c1")]["type"] == "t1" and category[("4chan", "c2")]["count_all"] == 0
    once = {(r["platform"], r["category"]): r for r in lines(spark, f"{out}/rollups/category_once")}
    assert once[("4chan", "c1")]["count_all"] == rows["m1"].count_all  # every "red pill" has a "red"
    heat = lines(spark, f"{out}/rollups/heat_scale")
    assert min(h["scaled"] for h in heat) == 0 and max(h["scaled"] for h in heat) == 1


def test_drilldown_reads_one_partition(spark, done):
    out, rows, _ = done
    stored = tables.stored_hit_rows(spark, f"{out}/hit_rows")
    chosen = report.drilldown(stored, "m1", "sample")
    assert chosen.columns == report.DRILL_COLUMNS
    assert chosen.count() == rows["m1"].count_sample
    assert "PartitionFilters: [isnotnull(index" in chosen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(in_sample,true)" in chosen._jdf.queryExecution().executedPlan().toString()
    assert report.drilldown(stored, "m1").count() == rows["m1"].count_all + rows["m1"].count_qanon


def test_post_hits(spark):
    """One row per post; counts, lists and distinct posts equal those of the single hits."""
    rng = random.Random(2)
    markers = [(f"m{k}", "pq"[k % 2], f"c{k % 3}", f"g{k % 4}", 1) for k in range(12)] + [("x", "p", "c9", "g9", 1)]
    found = []
    for uid in range(400):
        for k in sorted(rng.sample(range(12), rng.randint(0, 5))):
            own = rng.random() < 0.6
            found.append((f"m{k}", uid, rng.randint(1, 4), own, not own, own and uid % 7 == 0))
    table = spark.createDataFrame(markers, "index string, platform string, category string, marker_group string, to_analyse int")
    hits = spark.createDataFrame(found, "index string, uid long, spans int, in_all boolean, in_qanon boolean, in_sample boolean")
    posts = stored(report.post_hits(hits, table))
    assert posts.count() == len({f[1] for f in found})
    assert sorted(report.scoped_counts(posts).collect()) == sorted(report.marker_counts(hits).collect())
    want = {(f[0], s, f[1]) for f in found for s, on in zip(report.SCOPES, f[3:]) if on}
    assert {tuple(r) for r in report.hit_uids(posts).collect()} == want
    names = {m[0]: m for m in markers}
    for level, at in (("category", 2), ("marker_group", 3)):
        distinct = {}
        for index, scope, uid in want:
            distinct.setdefault((names[index][1], names[index][at]), {}).setdefault(scope, set()).add(uid)
        once = rollups.once_per_post(posts, table, level)
        assert {(r[0], r[1]): tuple(r)[2:] for r in once.collect()} == {
            key: tuple(len(distinct.get(key, {}).get(s, ())) for s in report.SCOPES)
            for key in {(m[1], m[at]) for m in markers}}
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert "uid" not in "".join(line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_uid_lists_are_split(spark):
    uids = spark.range(1000).selectExpr("'m' as index", "'all' as scope", "id as uid")
    parts = report.uid_lists(uids, 100).collect()
    assert len(parts) == 10 and max(len(p.uids) for p in parts) < 160
    assert sorted(u for p in parts for u in p.uids) == list(range(1000))


def test_rollup_skips_sentinels(spark):
    columns = report.MARKER_COLUMNS + report.measure_columns()
    base = dict.fromkeys(columns, "x") | {"platform": "p", "category": "c", "marker_group": "g", "to_analyse": 1}

    def row(index, n):
        counts = {c: n for c in report.measure_columns() if not c.endswith(("_rel", "_ratio"))}
        rels = {c: "-1" if n < 0 else f"{n / 10:.10f}" for c in report.measure_columns() if c.endswith("_rel")}
        ratios = {c: -1.0 if n < 0 else 2.0 for c in report.measure_columns() if c.endswith("_ratio")}
        return base | counts | rels | ratios | {"index": index, "type": f"t{index}"}

    frame = spark.createDataFrame([row("2", 3), row("1", -1), row("3", 4)]).select(*columns)
    got = rollups.by_group(frame).first()
    assert got.count_all == 7 and got.count_all_rel == "0.7000000000" and got.type == "t1"
