"""Top-k search, Merkle manifest and lexical search against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import catalog, lexical, merkle, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLDER = "/root/testdata/sf0.001"


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_columnar_topk", "op12_merkle_manifest", "op13_norm_bucket_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    frame = catalog.QUERIES[name](spark, FOLDER)
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    expected = [tuple(row[names.index(c)] for c in frame.columns) for row in result.fetchall()]
    assert sorted(names) == sorted(frame.columns)
    assert collected(frame) == sorted(expected, key=str)


# --- 11 top-k


def plain_top(rows, asked, k):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for q, own in {(i, tuple(v)) for i, v in rows if i is not None and asked(i)}:
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i is None, i or 0) for i, v in rows if i != q)
        out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


VECTORS = "embedding array<float>, vec_id long, label int, id string, v int, seed string, rank int, score string"


def vector_table(spark, rows):
    return spark.createDataFrame([(v, i, 1, "a", 2, "b", 3, "c") for i, v in rows], VECTORS)


@pytest.mark.parametrize("spread", [0.0, 0.3, 5.0])
def test_top_k(spark, spread, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 37))
    rows = [(k, (centres[k % 4] + spread * rng.normal(size=37)).astype(np.float32).tolist()) for k in range(400)]
    rows += [(700 + k, rows[10][1]) for k in range(60)]  # copies, with equal scores
    rows += [(10, rows[10][1])] * 2 + [(None, rows[20][1])] * 3 + [(20, rows[30][1])]
    rows += [(800, None), (810, []), (820, [1.0, None]), (830, [float("nan")] * 37), (840, [float("inf")] * 37),
             (850, [0.0] * 37), (860, [3e5] * 37), (870, [-3e5] * 37), (880, [1.0, -2.0])]
    monkeypatch.setattr(topk, "VECTORS", 50)
    monkeypatch.setattr(topk, "TILE", 7)
    frame = topk.top_k(vector_table(spark, rows), F.col("id") % 10 == 0)
    want = plain_top(rows, lambda i: i % 10 == 0, 10)
    assert collected(frame) == want
    monkeypatch.setattr(topk, "QUERY_VALUES", 37 * 9)  # several blocks of queries
    assert collected(topk.top_k(vector_table(spark, rows), F.col("id") % 10 == 0)) == want


def test_top_k_of_few_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.1])]
    assert collected(topk.top_k(vector_table(spark, few), F.col("id") % 100 == 0)) == plain_top(few, lambda i: i % 100 == 0, 10)
    none = vector_table(spark, [(1, [1.0])])
    assert topk.top_k(none, F.col("id") % 100 == 0).count() == 0
    assert topk.top_k(none.limit(0), F.col("id") % 100 == 0).count() == 0


# --- 12 Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, at):
    steps = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        at //= 8
    return steps


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    leaves = []
    for d, source, lang, n, text in rows:
        leaf = H("".join(encoded(x) for x in (d, source, lang, n, text)))
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None
        other = H("".join(encoded(x) for x in (d, source, lang, n, text.translate(LOWER)))) if hit else leaf
        leaves.append(((lang is not None, (lang or "").encode()), (d is not None, d or 0), leaf, other, d))
    leaves.sort()
    groups = [list(g) for _, g in groupby(leaves, key=lambda x: x[0])]
    trees = [levels_of([x[2] for x in g]) for g in groups]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, (group, tree) in enumerate(zip(groups, trees)):
        for at, (_, _, leaf, other, d) in enumerate(group):
            steps = path(tree, at) + path(top, g)
            folded = other
            for left, right in steps:
                folded = H(left + folded + right)
            out.append((d, leaf, tree[-1][0], top[-1][0], H("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


DIGEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, pos int, grp string, digest int, row int"


def document_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCUMENTS)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # many rounds of small blocks
    monkeypatch.setattr(merkle, "BLOCK", 8 ** levels)
    rng = np.random.default_rng(5)
    rows = []
    for lang, n in (("en", 530), ("de", 64), ("fr", 65), ("es", 1), ("", 8), (None, 9), ("é", 2), *((f"l{k}", 1) for k in range(5))):
        rows += [(int(rng.integers(0, 10_000)), "s", lang, 5, f"Text é {rng.integers(0, 9)}") for _ in range(n)]
    rows += [(7, None, "en", None, None), (None, None, None, None, None), (None, "", "en", 0, ""), *[(8, "s", "en", 1, "COPY")] * 20]
    frame = merkle.manifest(document_table(spark, rows), merkle.tampered_text()).select(*DIGEST)
    assert collected(frame) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    one = [(6, "s", "en", 4, "A text" * 20_000)]
    own = document_table(spark, one)
    assert collected(merkle.manifest(own, merkle.tampered_text()).select(*DIGEST)) == plain_manifest(one)
    assert merkle.manifest(own).where("not verified").count() == 0
    assert merkle.manifest(own.limit(0), merkle.tampered_text()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 200, 512])
def test_witnesses_after_every_append(n):
    """The witness of every leaf folds to the root of the leaves so far."""
    digests = [H(str(k)) for k in range(n)]
    height = len(levels_of(digests)) - 1
    tree = merkle.Appender(height)
    for digest in digests:
        tree.append(digest)
    assert tree.finish() == levels_of(digests)[-1][0]
    for digest, steps in zip(digests, tree.witnesses):
        assert merkle.fold(digest, [s.sides() for s in steps]) == tree.root


# --- 13 lexical search


def plain_rank(docs, items, k):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    terms = [(d, Counter(t), len(t)) for d, t in terms if t]
    count, length = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, own, _ in terms for t in own)
    out = []
    for item, text in {(i, x or "") for i, x in items}:
        query, scores = Counter(TERM.findall(text.translate(LOWER))), []
        for d, own, n in terms:
            m = 75 + (25 * n * count) // length
            score = sum(c * math.floor(1000 * math.log((2.0 * count + 2) / (2.0 * df[t] + 1)))
                        * ((10 ** 9 * own[t]) // (1000 * own[t] + 12 * m)) for t, c in query.items() if t in own)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def text_tables(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, n int, terms string, length int"),
            spark.createDataFrame([(t, i, 1, "x") for i, t in items], "text string, item_id long, item int, times string"))


@pytest.mark.parametrize("bucket", [16, 4096])
def test_lexical_search(spark, bucket, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "FOCUS", 3)
    rng = np.random.default_rng(4)
    pool = np.array([f"Wort{k}" if k % 3 else f"é{k}" for k in range(300)])
    share = 1 / np.arange(1, 301)
    share /= share.sum()

    def text(n):
        return " ".join(rng.choice(pool, n, p=share))
    docs = [(k, text(int(rng.integers(1, 80)))) for k in range(500)]
    docs += [(900 + k, docs[3][1]) for k in range(60)] + [(3, docs[3][1])] * 2 + [(None, docs[3][1])] * 2
    docs += [(990, None), (991, ""), (992, " \n.-"), (993, text(20_000)), (994, "WORT1_wort1-É3 x y")]
    items = [(k, text(int(rng.integers(1, 40)))) for k in range(25)]
    items += [(1, items[1][1]), (50, docs[3][1]), (51, None), (52, "..."), (53, "nobody has this"), (None, items[2][1])]
    frame = lexical.rank(*text_tables(spark, docs, items))
    want = plain_rank(docs, items, 20)
    assert collected(frame) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 400)  # several blocks of items
    assert collected(lexical.rank(*text_tables(spark, docs, items))) == want


def test_lexical_search_of_empty_tables(spark):
    docs, items = text_tables(spark, [(1, "a b")], [(1, "a b")])
    assert collected(lexical.rank(docs, items)) == plain_rank([(1, "a b")], [(1, "a b")], 20)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.rank(d, i).count() == 0
    blank = text_tables(spark, [(1, None)], [(1, "a")])
    assert lexical.rank(*blank).count() == 0
