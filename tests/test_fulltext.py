"""Matching, rank and highlighting against SQLite's FTS5, which defines the semantics."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from postlens.functions import text
from postlens.operators import matching, ranking
from postlens.schema import CLOSE_TAG, OPEN_TAG
from postlens.sources import markers
from postlens.sources.markers import any_of, atom, none_of, prepare, marker_table

WORDS = ["red", "pill", "redpill", "Pill", "Café", "cafe", "cafés", "STRASSE", "straße", "ÎLE",
         "ile", "x1", "1x", "Ünder", "the", "The", "of", "黒猫", "naïve", "ſo", "so", "ς", "İst"]
GAPS = [" ", " ", " ", "\n", ", ", "-", "_", "'", " 😀 ", "​", "...", " ́ "]


def make_posts(n, seed):
    rng = random.Random(seed)

    def sentence(most):
        return "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randint(0, most)))

    rows = []
    for uid in range(n):
        body = None if rng.random() < 0.05 else rng.choice(["", "!", ">>1\n"]) + sentence(25)
        subject = sentence(4) if rng.random() < 0.3 else None
        extras = '{"thumbnail": "red_1.jpg"}' if rng.random() < 0.2 else None
        rows.append((uid, subject, body, extras))
    return rows


POSTS = make_posts(600, 11)

# In rows that only the other branch of the OR matches, FTS5 reports positions of the NEAR pair
# that belong to another row, so only the matching rows are compared.
ROWS_ONLY = {"NEAR(red ile, 2) OR so"}

# (query text, clauses)
CASES = [
    ("red", [any_of(atom("term", "red"))]),
    ("cafe", [any_of(atom("term", "CAFÉ"))]),
    ("cafe*", [any_of(atom("prefix", "cafe"))]),
    ("zzz", [any_of(atom("term", "zzz"))]),
    ('"red pill"', [any_of(atom("phrase", "red", "pill"))]),
    ('"red-pill"', [any_of(atom("term", "red-pill"))]),
    ('"red pill red"', [any_of(atom("phrase", "red", "pill", "red"))]),
    ('"the re"*', [any_of(atom("phrase_prefix", "the", "re"))]),
    ("^red", [any_of(atom("first", "red"))]),
    ('^"red pill"', [any_of(atom("first", "red", "pill"))]),
    ("red OR pill*", [any_of(atom("term", "red"), atom("prefix", "pill"))]),
    ("red OR re*", [any_of(atom("term", "red"), atom("prefix", "re"))]),
    ('"red pill" OR "pill red"', [any_of(atom("phrase", "red", "pill"), atom("phrase", "pill", "red"))]),
    ('"red pill" OR "the red pill of" OR pill',
     [any_of(atom("phrase", "red", "pill"), atom("phrase", "the", "red", "pill", "of"),
             atom("term", "pill"))]),
    ("red AND ile", [any_of(atom("term", "red")), any_of(atom("term", "ile"))]),
    ("(red OR so) AND (ile OR cafe*)",
     [any_of(atom("term", "red"), atom("term", "so")), any_of(atom("term", "ile"), atom("prefix", "cafe"))]),
    ("red NOT pill", [any_of(atom("term", "red")), none_of(atom("term", "pill"))]),
    ("red NOT (pill OR ile)",
     [any_of(atom("term", "red")), none_of(atom("term", "pill"), atom("term", "ile"))]),
    ("NEAR(red ile, 2)", [any_of(atom("near", "red", "ile", k=2))]),
    ("NEAR(red ile)", [any_of(atom("near", "red", "ile"))]),
    ('NEAR("red pill" the, 3)', [any_of(atom("near", "red pill", "the", k=3))]),
    ("NEAR(the of, 0)", [any_of(atom("near", "the", "of", k=0))]),
    ("NEAR(red pill the, 3)", [any_of(atom("near", "red", "pill", "the", k=3))]),
    ("NEAR(red pill the of, 6)", [any_of(atom("near", "red", "pill", "the", "of", k=6))]),
    ('NEAR("red pill" the "so of", 9)', [any_of(atom("near", "red pill", "the", "so of", k=9))]),
    ("NEAR(red red the, 2)", [any_of(atom("near", "red", "red", "the", k=2))]),
    ("NEAR(red ile, 2) OR so", [any_of(atom("near", "red", "ile", k=2), atom("term", "so"))]),
    ("黒猫", [any_of(atom("term", "黒猫"))]),
]


@pytest.fixture(scope="module")
def reference():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table idx using fts5(subject, body, extras)")
    con.executemany("insert into idx(rowid, subject, body, extras) values (?, ?, ?, ?)", POSTS)

    def run(query):
        return {uid: (rank, body) for uid, rank, body in con.execute(
            "select rowid, round(bm25(idx), 3), highlight(idx, 1, ?, ?) from idx where idx match ?",
            (OPEN_TAG, CLOSE_TAG, f"body : ({query})"))}

    return con, run


@pytest.fixture(scope="module")
def found(spark):
    """Results of all cases at once, for both ways of finding candidates."""
    posts = spark.createDataFrame(POSTS, "uid long, subject string, body string, extras string")
    posts = posts.withColumn("platform", F.lit("p"))
    rows = [(f"{i:02}", "p", "c", "t", "m", "g", q, 1, clauses) for i, (q, clauses) in enumerate(CASES)]
    table = marker_table(spark, rows)

    def run(limit):
        prepared = prepare(table, limit)
        assert prepared.small == (limit > 0)
        hits = ranking.ranked_hits(posts, prepared, ["body"], with_ends=True)
        marked = matching.marked_up("body", "result.spans", OPEN_TAG, CLOSE_TAG)
        out = {}
        for r in hits.select("marker", "uid", "rank", "spans", marked.alias("body")).collect():
            out.setdefault(int(r.marker), {})[r.uid] = (r.rank, r.body, r.spans)
        return out

    found = {"small": run(1000), "large": run(0)}
    sizes = markers.PART_KEYS, markers.PART_BYTES
    markers.PART_KEYS = 12
    try:
        found["parts"] = run(0)
    finally:
        markers.PART_KEYS = sizes[0]
    return found


@pytest.mark.parametrize("way", ["small", "large", "parts"])
@pytest.mark.parametrize("number", range(len(CASES)), ids=[c[0] for c in CASES])
def test_same_as_fts5(reference, found, way, number):
    expected = reference[1](CASES[number][0])
    ours = found[way].get(number, {})
    assert set(ours) == set(expected)
    for uid, (rank, body) in expected.items():
        if CASES[number][0] in ROWS_ONLY:
            continue
        assert ours[uid][1] == body
        assert ours[uid][2] == body.count(OPEN_TAG)
        assert ours[uid][0] == pytest.approx(rank, abs=1e-9)


def test_tokens_same_as_fts5(spark, reference):
    con, _ = reference
    con.execute("create virtual table vocab using fts5vocab(idx, 'instance')")
    expected = {}
    for term, doc, offset in con.execute("select term, doc, offset from vocab where col = 'body'"):
        expected.setdefault(doc, {})[offset] = term
    posts = spark.createDataFrame(POSTS, "uid long, subject string, body string, extras string")
    got = posts.selectExpr("uid", f"{text.tokens('body')} as t", f"{text.pieces('body')} as p",
                           "body").collect()
    for row in got:
        assert row.t == [expected.get(row.uid, {})[i] for i in range(len(expected.get(row.uid, {})))]
        if row.body is not None:
            assert "".join(row.p) == row.body
            assert sum(p[0].isalnum() for p in row.p) == len(row.t)


def test_large_table_shuffles_no_texts(spark, monkeypatch):
    """Thousands of keys, in parts; only the broadcasts of the marker tables move."""
    monkeypatch.setattr(markers, "PART_KEYS", 1_500)
    posts = spark.range(2_000).selectExpr(
        "id as uid", "concat('word', id % 700, ' pre', id, 'fix word', id % 11) as body", "'p' as platform",
        "cast(null as string) as subject", "cast(null as string) as extras")
    table = marker_table(spark, [
        (f"{k}", "p", "c", "t", "m", "g", "q", 1,
         [any_of(atom("term", f"word{k}"), atom("prefix", f"pre{k}"), atom("phrase", f"word{k}", f"pre{k}fix"))])
        for k in range(1_200)])
    prepared = prepare(table, 1_000)
    assert not prepared.small and len(prepared.parts) == 2
    found = matching.hits(posts, prepared, ["platform"], scoped=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffleExchange" not in plan and "Exchange hashpartitioning" not in plan
    want = {(str(k), i) for i in range(2_000) for k in range(1_200)
            if k in (i % 700, i % 11) or str(i).startswith(str(k))}
    assert {(r.marker, r.uid) for r in found.select("marker", "uid").collect()} == want


def test_prefix_hits_contain_term_hits(found):
    term, prefix = found["small"][1], found["small"][2]
    assert set(term) <= set(prefix)


def test_long_body_stays_fast(spark):
    """One text with 200,000 tokens that nearly all hit, also as phrase and near."""
    posts = spark.createDataFrame([(1, "red pill " * 100_000)], "uid long, body string").selectExpr(
        "*", "'p' as platform", "cast(null as string) as subject", "cast(null as string) as extras")
    cases = [
        [any_of(atom("term", "red"), atom("phrase", "red", "pill"))],
        [any_of(atom("near", "red", "pill", k=3))],
    ]
    table = marker_table(spark, [(str(i), "p", "c", "t", "m", "g", "q", 1, c) for i, c in enumerate(cases)])
    rows = matching.hits(posts, prepare(table), ["body"], with_ends=True).select(
        "marker", "spans", F.length(matching.marked_up("body", "result.spans", "<", ">")).alias("n"))
    got = {r.marker: (r.spans, r.n) for r in rows.collect()}
    assert got == {"0": (100_000, 900_000 + 200_000), "1": (200_000, 900_000 + 400_000)}


def test_large_table_cuts_texts_once(spark):
    """No filter below the explosion of the keys repeats what they are computed from."""
    rows = marker_table(spark, [("m", "p", "c", "t", "m", "g", "q", 1, [any_of(atom("term", "red"))])])
    posts = spark.createDataFrame(POSTS, "uid long, subject string, body string, extras string")
    found = matching.hits(posts.withColumn("platform", F.lit("p")), prepare(rows, 0), ["platform"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "split(" in line for line in plan.splitlines())


def test_length_counts_the_body_once_and_equally(spark):
    posts = spark.createDataFrame(POSTS, "uid long, subject string, body string, extras string")
    counted = matching.with_tokens(posts).selectExpr("dl", f"{matching.length()} as whole", "tokens")
    assert counted.where("dl <> whole").count() == 0
    plan = matching.with_tokens(posts).select("dl")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count(body" not in plan.replace("#", " ").replace("body ", "body")


def test_marked_up_texts_keep_every_piece(spark):
    rows = [("the red pill", [0, 2], [0, 2]), (" - red, red\n", [0], [1]), ("é́ red", [1], [1]), ("red", [], []),
            ("...", [], []), ("", [], []), (None, [], [])]
    got = spark.createDataFrame(rows, "body string, starts array<int>, ends array<int>").selectExpr(
        "body", "struct(starts, ends) as spans").select(matching.marked_up("body", "spans", "<", ">").alias("x"))
    assert [r.x for r in got.collect()] == [
        "<the> red <pill>", " - <red, red>\n", "é́ <red>", "red", "...", "", None]
