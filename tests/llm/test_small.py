"""The operators on odd rows and empty tables, against plain Python."""

import glob
import hashlib
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens.llm import (
    components, decontamination, html_crf, jaccard, kneser_ney, language, line_dedup, packing, pii,
    quality_rules, sharding, store, trees, words,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collected(frame):
    return [tuple(r) for r in frame.collect()]


def by_key(rows):
    return sorted(rows, key=str)


# --- words


def test_words_lines_and_hashes():
    texts = ["a bb\tccc", None, "", " \n x y é ", "bb a", "one\ntwo\n\none"]
    seen, lines = defaultdict(list), defaultdict(list)
    for limit in (1, 5, 1 << 20):
        seen.clear()
        lines.clear()
        for piece in words.chunks(pa.array(texts), limit):
            for what, into in ((piece.words(), seen), (piece.lines(), lines)):
                h = piece.hashes(what[0], what[1])
                for s, e, r, x in zip(*what, h, strict=True):
                    into[piece.first + r].append((bytes(piece.buffer[s:e]).decode(), x))
        for k, text in enumerate(texts):
            assert [w for w, _ in seen[k]] == WORD.findall(text or "")
            assert [x for x, _ in lines[k]] == [x for x in (text or "").split("\n") if x]
    names = defaultdict(set)
    for found in (seen, lines):
        for values in found.values():
            for text, x in values:
                names[x].add(text)
    assert all(len(v) == 1 for v in names.values())
    assert seen[0][1][1] == seen[4][0][1]


# --- 1 sharding


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding(odd_docs, shards):
    rows = sharding.shard_rows(odd_docs, shards, cells=64).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                   for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == odd_docs.count()


def test_sharding_of_many_copies_and_of_nothing(spark, no_docs):
    many = spark.range(45_000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard_rows(many, 4, cells=16)
    counts = {r.shard: (r["n"], r.top) for r in rows.groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert counts == {s: (11_250, 11_249) for s in range(4)}
    assert sharding.shard_rows(no_docs, 3).count() == 0


def test_few_rows_move_when_a_shard_is_added():
    counts = np.full(4096, 100)

    def owners(shards):
        out = np.zeros((4096, 100), int)
        for cell, low, high, shard, _ in sharding.walk(counts, shards, 0.05):
            out[cell, low:high] = shard
        return out
    before, after = owners(10), owners(11)
    assert max(np.bincount(after.ravel())) <= 1.05 * counts.sum() / 11 + 1
    assert (before != after).mean() < 0.3


# --- 2 quality rules


def test_statistics(odd_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, 0, None), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.rate(odd_docs, labels).collect()}
    for d in odd_docs.collect():
        text = d.text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = rows[d.doc_id, len(w)]
        assert r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_rules_without_labels(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.rate(odd_docs, none).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and len(rows) == odd_docs.count()
    assert quality_rules.rate(no_docs, none).count() == 0


def test_trees_are_monotone_and_equal_their_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] - 0.3 * x[:, 2] + rng.normal(size=3000) * 0.4 > 0).astype(float)
    model = trees.fit(x, y, [1, 1, -1], rounds=25)
    assert ((model.margins(x) > 0) == y).mean() > 0.75
    for f, way in ((0, 1), (1, 1), (2, -1)):
        low, high = x.copy(), x.copy()
        high[:, f] += rng.random(3000) * 2
        assert (way * (model.margins(high) - model.margins(low)) >= -1e-9).all()
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r[0] for r in frame.select(model.column([F.col(c) for c in "abc"])).collect()]
    assert np.allclose(got, model.margins(x[:50]))


# --- 3 packing


def checked_packing(docs, lengths):
    rows = packing.pack(docs, lengths).collect()
    want = Counter()
    for d in docs.collect():
        n = len(WORD.findall(d.text or ""))
        for piece in range(-(-n // max(lengths)) or 1):
            want[d.doc_id, piece, min(max(lengths), n - piece * max(lengths))] += 1
    assert Counter((r.doc_id, r.piece, r.n_words) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            bins[r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.n_words for x in own[:k]) for k in range(len(own))]
        used = sum(r.n_words for r in own)
        assert {r.capacity for r in own} == {min(c for c in lengths if c >= used)}
    return bins


def test_packing(odd_docs, no_docs):
    checked_packing(odd_docs, (16, 32, 64))
    checked_packing(odd_docs, (8,))
    assert packing.pack(no_docs).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 2000, 5000).tolist())
    rows = packing.plan(histogram)
    used = Counter()
    for n, low, high, first, each, _, _ in rows:
        for r in range(low, high):
            used[first + (r - low) // each] += n
    sizes = [min(c for c in packing.SEQUENCE_LENGTHS if c >= u) for u in used.values()]
    assert sum(used.values()) == sum(n * m for n, m in histogram.items())
    assert sum(used.values()) / sum(sizes) > 0.97


# --- 4 Kneser-Ney


def test_kneser_ney_equals_a_plain_model(spark, odd_docs):
    texts = ["the cat sat on the mat", "the dog sat on the mat", "a cat and a dog", "the mat and the cat",
             "on the mat the dog sat", "zebra", "", None, "a dog sat on a cat and the cat"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5)] + [(6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in kneser_ney.perplexities(docs, labels, size=6).collect()}
    folds = {r.doc_id: r.body & 1 for r in rows.values()}
    for k, text in enumerate(texts):
        w = (text or "").split()
        assert rows[k].n_words == len(w) and rows[k].events == (len(w) + 1 if w else 0)
        if w:
            model = plain_model([texts[j].split() for j in range(5) if folds[j] != folds[k]], 6)
            assert rows[k].log == pytest.approx(sum(model(a, b) for a, b in zip([1, *w], [*w, 1], strict=True)), abs=1e-4)
    judged = kneser_ney.classify(odd_docs, labels).collect()
    assert len(judged) == odd_docs.count()
    assert all(not r.kept for r in judged if r.n_words == 0)


def plain_model(texts, size):
    counts = Counter(w for t in texts for w in t)
    hashed = {}
    for w in counts:
        piece = next(words.chunks(pa.array([w])))
        hashed[w] = int(piece.hashes(*piece.words()[:2])[0].astype(np.int64))
    vocabulary = set(sorted(counts, key=lambda w: (-counts[w], hashed[w]))[:size])
    others = max(1, len(counts) - len(vocabulary))
    pairs = Counter((a, b) for t in texts for a, b in zip(
        [1, *(w if w in vocabulary else 0 for w in t)], [*(w if w in vocabulary else 0 for w in t), 1], strict=True))
    cut = kneser_ney.discounts([float(sum(c == k for c in pairs.values())) for k in (1, 2, 3, 4)])
    into = Counter(b for _, b in pairs)
    low = kneser_ney.discounts([float(sum(c == k for c in into.values())) for k in (1, 2, 3, 4)])
    total, kinds = Counter(), defaultdict(Counter)
    for (a, _), c in pairs.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1
    spread = sum(low[min(c, 3)] for c in into.values()) / (len(vocabulary) + 2)

    def log(a, b):
        a, b = (x if x in vocabulary or x == 1 else 0 for x in (a, b))
        lower = (max(0, into[b] - low[min(into[b], 3)]) + spread) / max(1, sum(into.values()))
        left = max(1e-9, sum(cut[k] * m for k, m in kinds[a].items()) / total[a]) if total[a] else 1.0
        c = pairs[a, b]
        p = max(0, c - cut[min(c, 3)]) / max(1, total[a]) + left * max(lower, 1e-12)
        return np.log(p) - (np.log(others) if b == 0 else 0)
    return log


def plain_lower(texts):
    """N(. w) and continuation probability of the words of a fold with all its words."""
    pairs = {(a, b) for t in texts for a, b in zip([1, *t], [*t, 1], strict=True)}
    into = Counter(b for _, b in pairs)
    low = kneser_ney.discounts([float(sum(c == k for c in into.values())) for k in (1, 2, 3, 4)])
    spread = sum(low[min(c, 3)] for c in into.values()) / (len({w for t in texts for w in t}) + 2)
    return into, lambda w: max((max(0, into[w] - low[min(into[w], 3)]) + spread) / max(1, len(pairs)), 1e-12)


def test_kneser_ney_with_all_words_and_toxic_folds(spark):
    """What the query does: no limit of words, 64 shards of each fold, slices, and the toxic ratio."""
    rng = np.random.default_rng(12)
    pool, foul = [f"w{i}" for i in range(120)], [f"foul{i}" for i in range(6)]
    texts = [" ".join(rng.choice(pool if k % 4 else pool + foul * 6, int(rng.integers(0, 50)))) for k in range(120)]
    texts += [texts[5], "never seen words", "foul1 foul2"]
    labels = {k: (1, int(k % 4 == 0)) for k in range(90)}
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in kneser_ney.perplexities(docs, table).collect()}
    assert len(rows) == len(texts)
    split = {k: t.split() for k, t in enumerate(texts)}
    for f in (0, 1):  # the documents of the other fold are judged
        trusted = [split[k] for k, v in labels.items() if v == (1, 0) and rows[k].body & 1 == f and split[k]]
        toxic = [split[k] for k, v in labels.items() if v[1] and rows[k].body & 1 == f and split[k]]
        model, (_, lower), (kinds, bad) = plain_model(trusted, 10**9), plain_lower(trusted), plain_lower(toxic)
        for k, w in split.items():
            if w and rows[k].body & 1 != f:
                assert rows[k].log == pytest.approx(sum(model(a, b) for a, b in zip([1, *w], [*w, 1], strict=True)), rel=1e-5)
                ratio = [bad(a) / lower(a) if kinds[a] > 1 else 0.0 for a in [1, *w]]
                assert rows[k].toxic_ratio == pytest.approx(
                    float(np.log1p(kneser_ney.TOXIC_SHARE * (np.array(ratio) - 1)).sum()), rel=1e-4, abs=1e-6)


def test_kneser_ney_counts_bigrams_of_all_words(spark):
    filler = " ".join(f"f{i}" for i in range(65_000))
    rare = [[f"r{k}x{i}" for i in range(40)] for k in range(6)]
    trusted = [(k, f"{filler} {filler} {' '.join(own)}") for k, own in enumerate(rare)]
    asked = {(k, j, way): 100 + 100 * k + 2 * j + (way < 0) for k in range(6) for j in range(6) for way in (1, -1)}
    new = [(n, " ".join([*rare[k][::way], *["f0"] * j])) for (k, j, way), n in asked.items()]
    docs = spark.createDataFrame([(n, t, "en") for n, t in trusted + new], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in kneser_ney.perplexities(docs, labels).collect()}
    compared = 0
    for k in range(6):
        for j in range(6):
            forth, back = rows[asked[k, j, 1]], rows[asked[k, j, -1]]
            if {forth.body & 1, back.body & 1} == {1 - (rows[k].body & 1)}:  # both by the model that read k
                assert forth.log > back.log + 39
                compared += 1
    assert compared


def test_kneser_ney_rejects_toxic_text(spark):
    rng = np.random.default_rng(3)
    common, foul = [f"w{i}" for i in range(200)], [f"foul{i}" for i in range(8)]
    plain = [" ".join(rng.choice(common, 60)) for _ in range(300)]
    bad = [" ".join([*rng.choice(common, 50), *rng.choice(foul, 10)]) for _ in range(80)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(plain + bad)],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(340)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.classify(docs, labels, quantile=0.0).collect() if r.kept}
    assert not kept & set(range(300, 380))  # labelled or not
    assert len(kept) >= 295
    clean = labels.where("toxic = 0")
    assert set(range(300)) <= {r.doc_id for r in kneser_ney.classify(docs, clean, quantile=0.0).collect() if r.kept}


def test_kneser_ney_without_trusted_text(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(kneser_ney.classify(odd_docs, none).collect()) == odd_docs.count()
    assert kneser_ney.classify(no_docs, none).count() == 0


# --- 5 line dedup


def plain_lines(docs):
    holders = defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for k, d in enumerate(docs):
        for line in (d.text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add((-1 if d.doc_id is None else d.doc_id, k))
    out = []
    for d in docs:
        lines = (d.text or "").split("\n")
        mine = -1 if d.doc_id is None else d.doc_id
        kept = [x for x in lines if len(holders[key(x)]) < 5 or mine == max(holders[key(x)])[0]]
        out.append((d.doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def line_rows(docs):
    return collected(line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)))


def test_line_dedup(odd_docs, no_docs):
    assert by_key(line_rows(odd_docs)) == by_key(plain_lines(odd_docs.collect()))
    assert sum(r[2] for r in line_rows(odd_docs)) > 0
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_hot_lines(spark):
    long = "this very long line is found in a great number of all documents here"
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat_ws(
        "\n", F.lit(long), F.concat(F.lit("own line "), F.col("id").cast("string")), F.lit(long)).alias("text"))
    assert by_key(line_rows(docs)) == by_key(plain_lines(docs.collect()))


# --- 6 personal data


@pytest.mark.parametrize("text,want", [
    ("mail a.b@c.de and x@y", "email:5:13"),
    ("a@b.c_x@d.e", "email:0:5,email:5:11"),
    ("host 10.0.0.255 not 1.2.3.256 or 1.2.3.4.5", "ip:5:15,ip:33:40"),
    ("é 4111 1111 1111 1111 x", "card:2:21"),
    ("card 4111111111111112 no", ""),
    ("call +1 (456) 555-2186 now", "phone:5:22"),
    ("", ""), (None, ""),
])
def test_base_spans(spark, text, want):
    frame = spark.createDataFrame([(text,)], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    assert frame.select(pii.listed(pii.base_spans(F.col("text")))).first()[0] == want


PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(text):
    def luhn(digits):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if {0: True, 1: all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True,
                2: 16 <= len(digits) <= 19 and luhn(digits), 3: 8 <= len(digits) <= 15}[kind]:
                out.append(f"{pii.KINDS[kind]}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = np.random.default_rng(9)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "(", ")", "1", "25", "255", "256", "4111111111111111", "4111 1111",
            "é", "😀", "%", "_", "\n", "x@y.z", "10.0.0.1", "+49 30 123456", "0000", "17", "-", "3"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 30)))) for _ in range(3000)]
    frame = spark.createDataFrame(enumerate(texts), "k int, text string").repartition(8)
    rows = frame.select("text", pii.listed(pii.base_spans(F.col("text"))).alias("spans")).collect()
    assert len(rows) == 3000 and [(r.text, r.spans) for r in rows if r.spans != plain_base(r.text)] == []


def test_spans_of_a_long_text(spark):
    """32,000 matches in one text, half of them proposals."""
    piece = "a@b.cd and k at l dot com "
    docs = spark.createDataFrame([(1, piece * 16_000), (2, "é" + piece)], "doc_id long, text string")
    started = time.monotonic()
    rows = {r.doc_id: r for r in pii.redactions(docs).select(
        "doc_id", F.size("base").alias("base"), "spans").collect()}
    assert time.monotonic() - started < 150
    assert rows[1].base == 16_000 and rows[2].base == 1
    own = [(s.kind, s.start, s.end) for s in rows[2].spans]
    assert len(rows[1].spans) == 16_000 * len(own)
    assert [(s.kind, s.start - 26 * (k // len(own)) + 1, s.end - 26 * (k // len(own)) + 1)
            for k, s in enumerate(sorted(rows[1].spans, key=lambda s: s.start))] == sorted(own, key=lambda s: s[1]) * 16_000


def test_added_spans(spark, odd_docs, no_docs):
    texts = ["contact jane.doe [at] web-post [dot] com today", "call (212) 555-0187 now", "plain words only",
             "order no. 12345678901234 of the part", "x@y.org and +49 30 1234567"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.redactions(docs).withColumn(
        "clean", pii.redacted(F.col("text"), F.col("spans"))).collect()}
    assert rows[0].clean == "contact [email] today" and rows[1].clean == "call [phone] now"
    assert rows[2].clean == texts[2] and rows[3].clean == texts[3]
    assert rows[4].clean == "[email] and [phone]"
    for r in rows.values():
        assert all(r.text[s.start:s.end] == s.value for s in r.spans)
    assert pii.redactions(odd_docs).count() == odd_docs.count()
    assert pii.redactions(no_docs).count() == 0


# --- 7 Jaccard join


def plain_components(docs, size, percent):
    sets = []
    for d in docs:
        w = [x.translate(LOWER) for x in WORD.findall(d.text or "")]
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else
                    {tuple(w)} if w else set())
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for k, g in enumerate(group):
        if docs[k].doc_id is not None:
            least[g].append(docs[k].doc_id)
    return [(d.doc_id, len(sets[k]), min(least[group[k]], default=None)) for k, d in enumerate(docs)]


def near_copies(spark, seed=4):
    rng = np.random.default_rng(seed)
    pool = np.array([f"w{k}" for k in range(300)])
    rows, at = [], 0
    for _ in range(6):
        base = rng.choice(pool, rng.integers(10, 120))
        for _ in range(rng.integers(2, 40)):
            text = base.copy()
            spots = rng.integers(0, len(base), rng.integers(0, 4))
            text[spots] = rng.choice(pool, len(spots))
            rows.append((at, " ".join(text)))
            at += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("changes", [{}, {"SALT_ROWS": 5}, {"BLOCK": 4}])
def test_jaccard(spark, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = near_copies(spark)
    rows = collected(jaccard.components_of(docs))
    assert by_key(rows) == by_key(plain_components(docs.collect(), 4, 85))


def test_jaccard_on_odd_rows(odd_docs, no_docs):
    got = collected(jaccard.components_of(odd_docs))
    assert by_key(got) == by_key(plain_components(odd_docs.collect(), 4, 85))
    assert jaccard.components_of(no_docs).count() == 0
    kept = jaccard.representatives(odd_docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert len([r for r in kept if r.doc_id is None]) == 2


def test_overlap_bound_is_never_too_small():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.r_[rng.choice(a, rng.integers(0, len(a) + 1), replace=False),
                            rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)])
        if len(b):
            x, y = (np.frombuffer(jaccard.signature(s), np.uint8) for s in (a, b))
            width = min(len(x), len(y))
            bound = jaccard.overlap_bound(len(a), len(b), jaccard.folded(x, width), jaccard.folded(y, width))
            assert bound >= len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (20, 21), (22, 21), (5, 4), (1, 2)]
    rows = dict(collected(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert rows == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    chain = spark.range(200).selectExpr("id a", "id + 1 b")
    assert set(dict(collected(components.components(chain))).values()) == {0}


# --- 8 language


def test_language(odd_docs, no_docs, spark):
    rows = language.identify(odd_docs, F.col("lang"), [F.col("source")]).collect()
    assert len(rows) == odd_docs.count()
    for r, d in zip(sorted(rows, key=lambda r: str((r.doc_id, r.body))), odd_docs.select(
            "doc_id", F.xxhash64("text").alias("body"), "text").collect(), strict=False):
        assert r.kept == (r.language != "und" and r.confidence >= 0.5)
    assert all(r.language == "und" and not r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert {r.language for r in rows if r.doc_id == 5} == {"fr"}
    assert language.identify(no_docs, F.col("lang"), [F.col("source")]).count() == 0


def test_host_and_suffix_evidence(spark):
    texts = {"en": "the cat and the dog went to the market with the other people",
             "fr": "le chat et le chien sont dans la maison avec les autres gens"}
    rows = [(k, texts["en" if k % 3 else "fr"], "en" if k % 3 else "fr", "a.com" if k % 3 else "b.fr",
             "h1.a.com" if k % 3 else "h2.b.fr", "com" if k % 3 else "fr") for k in range(120)]
    rows += [(200, "no", None, "b.fr", "h9.b.fr", "fr"), (201, "no", None, "a.com", "h8.a.com", "com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, domain string, host string, suffix string")
    found = {r.doc_id: r for r in language.identify(
        docs, F.col("lang"), [F.col("domain"), F.col("host")], F.col("suffix"), languages=("en", "fr")).collect()}
    assert all(found[k].language == ("en" if k % 3 else "fr") for k in range(120))
    assert found[200].language == "fr" and found[201].language == "en"


# --- 9 main text


@pytest.mark.parametrize("page,want", [
    ("<article><h1>A &amp; B</h1><p>One\n two.<p>Three <b>four</b>&nbsp;five.</article>", ["A & B", "One two.", "Three four five."]),
    ("<p>a<script>var x='</p>';</script>b<!-- c --><br>d</p>", ["a b d"]),
    ("<div title='a > b'>x</div", ["x", "</div"][:1]),
    ("plain", ["plain"]), ("", []), ("<nav><ul><li>m<li>n</ul></nav>", ["m", "n"]),
    ("<p>a <math><mi>x</mi>=<mn>1</mn></math> b</p>", ["a x=1 b"]),
    ("<iframe src=y><p>rest of the article", ["rest of the article"]),
    ("<svg><text>drawn</text></svg><p>x<object>y</object><canvas>z", ["drawn", "xyz"]),
    ("<p>x<textarea>lost</textarea>y<select><option>z</select></p><p>k<title>open", ["x y", "k open"]),
    ("<p>&am<b>p;</b> &l<!-- c -->t; &amp;lt; caf&eacute;</p>", ["&amp; &lt; &lt; café"]),
    ("<p>x</p><noscript>turn it on</noscript><p>y<script>gone", ["x", "turn it on", "y"]),
])
def test_leaf_blocks(page, want):
    assert [t for t, _, _ in html_crf.leaf_blocks(page)][: len(want)] == want


def test_viterbi_equals_all_chains():
    rng = np.random.default_rng(2)
    for k in range(40):
        field = html_crf.Field(rng.normal(size=(len(html_crf.NAMES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        page = html_crf.made_pages(40, seed=k)[k].replace("\x01", "")
        page = page[: len(page) // 3] if len(html_crf.leaf_blocks(page)) > 12 else page
        blocks = html_crf.leaf_blocks(page)[:12]
        if len(html_crf.leaf_blocks(page)) > 12 or not blocks:
            continue
        scores = [field.emit[html_crf.path_features(p) + html_crf.text_features(t, w, i == 0)].sum(0)
                  for i, (t, p, w) in enumerate(blocks)]
        scored = {y: field.start[y[0]] + sum(s[v] for s, v in zip(scores, y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
                  for y in product((0, 1), repeat=len(blocks))}
        top = max(scored.values())
        assert field.main_text(page) in {
            "\n".join(b[0] for b, v in zip(blocks, y) if v) for y, score in scored.items() if score > top - 1e-9}


def test_training_runs_cover_whole_pages(spark, monkeypatch):
    page = "<article>" + "".join(f"<p>Line {k}.</p>" for k in range(300)) + "</article><footer>last</footer>"
    x, y = html_crf.marked_up(page)
    found = html_crf.runs((x, y))
    assert [len(r[1]) for r in found] == [120, 120, 61] and [r[2] for r in found] == [True, False, False]
    assert sum((r[0] for r in found), []) == x and found[-1][1][-1] == 0
    seen = []
    monkeypatch.setattr(html_crf, "fit", lambda taught: seen.append(taught))
    html_crf.train(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    assert sorted(len(r[0]) for r in seen[0][-3:]) == [61, 120, 120]


def test_field_on_unseen_layouts(spark):
    field = html_crf.fit([r for p in html_crf.made_pages() for r in html_crf.runs(html_crf.labelled(p))])
    right = []
    for page in html_crf.made_pages(120, seed=77):
        want = "\n".join(t.replace("\x01", "") for t, _, _ in html_crf.leaf_blocks(page) if "\x01" in t)
        right.append(field.main_text(page.replace("\x01", "")) == want)
    assert np.mean(right) > 0.85
    pages = spark.createDataFrame(
        [(1, "u", None), (None, None, ""), (2, "u", "<body><nav><a>m</a></nav><article><p>Long words of a text.</p></article>"),
         (2, "u", "<body><nav><a>m</a></nav><article><p>Long words of a text.</p></article>")],
        "page_id long, url string, html string")
    rows = collected(html_crf.extract(pages))
    assert by_key(rows) == by_key([(1, "u", ""), (None, None, ""), *[(2, "u", "Long words of a text.")] * 2])
    assert html_crf.extract(pages.limit(0)).count() == 0


# --- 10 decontamination


def plain_leaks(texts, items):
    def features(text):
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate(LOWER))
        size = min(5, len(w))
        return len(w), size, [tuple(w[k:k + size]) for k in range(len(w) - size + 1)] if w else [], w
    out = set()
    for d, text in texts:
        words_ = features(text or "")[3]
        for i, item in items:
            n, size, own, _ = features(item or "")
            if not n or len(words_) < size:
                continue
            every = [tuple(words_[k:k + size]) for k in range(len(words_) - size + 1)]
            length = min(len(own), len(every))
            for at in range(len(every) - length + 1):
                a, b = Counter(own), Counter(every[at:at + length])
                if 10 * sum((a & b).values()) >= 8 * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    pool = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(pool, n))) for k, n in enumerate([3, 8, 20, 40, 40, 60])] + [(50, ""), (51, None), (52, "?")]
    texts = []
    for k in range(60):
        own = rng.choice(pool, rng.integers(0, 120)).tolist()
        item = items[k % 6][1].split()
        if k % 3:
            for _ in range(k % 4):
                item[rng.integers(0, len(item))] = "changed"
            at = rng.integers(0, len(own) + 1)
            own[at:at] = [w.upper() + "," for w in item]
        texts.append((k, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == plain_leaks(texts, items)
    verdicts = decontamination.decontaminate(odd_docs, benchmark).collect()
    assert len(verdicts) == odd_docs.count() and not any(r.contaminated for r in verdicts)
    assert decontamination.decontaminate(no_docs, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(10 + k))) for k in range(7)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("x y z "), "text").alias("text"))
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 3)
    rows = decontamination.matches(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.word) for r in rows) == [(k, k, 3) for k in range(7)]


def test_fingerprints_count_occurrences():
    """Against the definition: signs of all (feature, k-th occurrence) of a window added up."""
    rng = np.random.default_rng(1)
    for kinds, n, length in ((3, 60, 20), (40, 60, 20), (1, 30, 9), (5, 12, 12), (1000, 50, 7)):
        features = words.mix(rng.integers(0, kinds, n).astype(np.uint64))
        first, last = (3, n - length - 2) if n > length + 6 else (0, n - length)
        got = decontamination.fingerprints(features, first, last, length)
        for w in range(first, last + 1):
            seen, total = Counter(), np.zeros(128, np.int64)
            for f in features[w: w + length]:
                seen[f] += 1
                total += decontamination.signs(decontamination.numbered(np.array([f]), np.array([seen[f]])))[0]
            assert (got[w - first] == np.packbits(total > 0)).all()


@pytest.mark.parametrize("size,replaced", [(200, 17), (300, 28), (60, 2)])
def test_passages_with_a_repeated_word(spark, size, replaced):
    """Part of the item is replaced by one repeated word; the similarity stays just above 0.8."""
    rng = np.random.default_rng(size)
    items, texts = [], []
    for k in range(40):
        item = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        at = int(rng.integers(5, size - replaced - 5))
        items.append((k, " ".join(item)))
        texts.append((k, " ".join(["before"] * 30 + item[:at] + ["again"] * replaced + item[at + replaced:] + ["z"] * 9)))
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, k) for k in range(40)}
    assert all(0.8 <= r.similarity < 0.86 for r in rows)


def test_a_long_repetitive_text_is_searched_in_bounded_memory():
    index = decontamination.Index([(1, "word " * 50)])
    text = pa.array(["word " * 100_000 + "x y z"])
    tracemalloc.start()
    found = [f for piece in words.chunks(text) for f in index.search(piece)]
    assert found[0][:3] == (0, 1, 0) and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


# --- 7 rounds of the join


def test_exhaustive_round_follows_an_empty_one(spark, monkeypatch):
    """A link that only the last round can propose is found if the round before proposes nothing new."""
    own = jaccard.tile_pairs
    asked = []

    def nothing_likely(tiles, nodes, labels, percent, likeliest):
        asked.append(likeliest)
        pairs = own(tiles, nodes, labels, percent, likeliest)
        return pairs.limit(0) if likeliest else pairs
    monkeypatch.setattr(jaccard, "tile_pairs", nothing_likely)
    rng = np.random.default_rng(3)
    texts = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(103)]
        for c in range(6):
            text = list(base)
            text[int(rng.integers(0, 43))] = f"changed{g}x{c}"
            texts.append((10 * g + c, " ".join(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = collected(jaccard.components_of(docs).select("doc_id", "component_id"))
    sets = {d: {tuple(t.split()[k:k + 4]) for k in range(100)} for d, t in texts}
    least = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert asked == [True, False] and sorted(rows) == sorted(least.items())
    assert len(set(least.values())) < len(sets)


def test_meeting_with_one_large_set():
    """Bitmaps are not padded to the widest: one large set among many small ones costs little."""
    rng = np.random.default_rng(6)
    members = [np.unique(words.mix(rng.integers(0, 1 << 62, 60).astype(np.uint64))) for _ in range(1500)]
    members.append(np.unique(words.mix(np.arange(300_000, dtype=np.uint64))))
    members[1] = members[0].copy()
    rows = sorted((0, k, len(m), -1, k, jaccard.signature(m)) for k, m in enumerate(members))
    rows.sort(key=lambda r: (r[2], r[1]))
    tracemalloc.start()
    pairs = jaccard.meeting(rows, 85, False)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert (0, 1) in set(zip(*pairs.tolist()))


def test_order_of_shingles_holds_one_slice_at_a_time():
    width = jaccard.BUCKETS // jaccard.SLICES

    def slices():
        for k in reversed(range(jaccard.SLICES)):
            counts = np.full(width, 2, np.int64)
            counts[k] = 1000 * (k + 1) + 60_000
            yield k, counts

    tracemalloc.start()
    order = jaccard.Order(slices())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * jaccard.BUCKETS
    total = np.concatenate([counts for _, counts in sorted(slices(), key=lambda x: x[0])])
    assert (order.rank == np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)).all()
    assert order.hot.tolist() == [k * width + k for k in range(jaccard.SLICES)]
    assert order.salts(np.array([0, 1, order.hot[-1]])).tolist() == [2, 1, 3]


def test_kneser_ney_small_shards_share_files(spark, tmp_path, monkeypatch):
    """As many files as the size asks for, not one for each shard."""
    docs = [(i, f"word{i} and word{i * 7 % 50} of a text", "en") for i in range(300)]
    trusted = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr(
        "int(doc_id % 4) as fold", "text")
    vocabulary, _ = kneser_ney.vocabulary_of(trusted, None)
    counted = kneser_ney.counted_bigrams(trusted, vocabulary)
    assert counted.select("shard").distinct().count() == counted.count() > 100
    assert len(counted.inputFiles()) <= 4 and len(kneser_ney.continuations(counted).inputFiles()) <= 4


def test_kneser_ney_slices_ask_every_bigram_once(spark, odd_docs, monkeypatch):
    """A slice asks its own shards only, and the rows of all slices add up to one for each document."""
    monkeypatch.setattr(kneser_ney.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = pa.array([" ".join(f"w{k * j % 97}" for j in range(60)) for k in range(20)] + ["", "one"])
    own = pa.RecordBatch.from_arrays([pa.array(range(22))] * 2 + [pa.array(["en"] * 22)], kneser_ney.CARD)
    vocabulary = kneser_ney.Vocabulary(np.zeros(0, np.uint64), None)
    piece = next(words.chunks(texts))
    asked, cards = Counter(), set()
    for part in range(kneser_ney.SLICES):
        block = kneser_ney.Asked(0, 0, part)
        block.add(piece, own, vocabulary)
        for row in (r.to_pylist()[0] for r in block.rows()):
            if row["kind"] == kneser_ney.PLACES:
                cards.add(str(pa.ipc.open_stream(row["card"]).read_all().select(["n_words", "events"]).to_pydict()))
                continue
            assert kneser_ney.slice_of(row["shard"] // 2) == part
            u, w = kneser_ney._unpack_pairs(row["heads"], row["lengths"], row["seconds"])
            for a, b, n in zip(u, w, kneser_ney._unpack(row["counts"], np.uint32), strict=True):
                asked[int(a), int(b)] += int(n)
    u, w, _ = kneser_ney.bigrams(*vocabulary.numbered(piece, 1), piece.rows)
    assert asked == Counter(zip(u.tolist(), w.tolist(), strict=True)) and len(cards) == 1
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    found = kneser_ney.perplexities(odd_docs, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd_docs.collect())
    assert {r.doc_id for r in found if r.trusted} == {1, 5}


def test_shuffle_files_go_with_their_query(spark):
    """They do not wait for a collection on the driver, and later queries keep theirs."""
    def files():
        return set(glob.glob(os.environ.get("SPARK_LOCAL_DIRS", "/tmp") + "/blockmgr-*/*/shuffle_*.data"))

    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    before, usual = files(), spark.conf.get(store.CLEANUP)
    with store.shuffles_dropped(spark):
        kept = [store.written(rows.repartition(3, "k")) for _ in range(3)]
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and [k.count() for k in kept] == [1000] * 3
    assert spark.conf.get(store.CLEANUP) == usual
    again = rows.repartition(3, "k").persist()
    assert again.count() == again.count() == 1000 and files() - before
    again.unpersist()


def test_kneser_ney_looks_words_up_by_leading_bits():
    rng = np.random.default_rng(8)
    for size in (0, 1, 3000):
        # Many share their leading bits; both ends of the range are there.
        table = np.unique(rng.integers(0, 1 << 48, size, dtype=np.uint64) << rng.choice(np.uint64([0, 16]), size))
        table = np.r_[table, np.uint64(2**64 - 1)] if size > 1 else table
        asked = np.r_[table, table + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.uint64([0, 2**64 - 1])]
        at, there = kneser_ney.Vocabulary(table, None).placed(asked)
        assert (there == np.isin(asked, table)).all() and (table[at[there]] == asked[there]).all()
