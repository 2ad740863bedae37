"""Personal data by candidate gradient boosting, in column expressions only.

Plain patterns with checks find emails, addresses, cards and phones (the base). Looser generators
propose further, possibly overlapping spans: disguised emails and addresses, phones without a
plus, cards of other shapes. Boosted trees score each proposal by its format and context, a
threshold per kind, calibrated for precision on held-out examples, selects, and of overlapping
ones the best scored stays. All of it happens within a row: no shuffle, no Python on the executors.

The trees learn from labelled examples made by a rule below and from proposals in the
``MAX_TRAINING_TEXTS`` different texts with the smallest hash (``MAX_TRAINING_ROWS`` proposals at most)
labelled by checksum and format.

Places are sums over blocks and overlaps are looked for in blocks, so a text with n matches takes
about n to the 1.5 steps.

Offsets are code points, ends exclusive. Null counts as empty; texts without matches get no spans;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import trees

KINDS = ["email", "ip", "card", "phone"]
MAX_TRAINING_ROWS, MAX_TRAINING_TEXTS = 4000, 4000
PRECISION = 0.99
CONTEXT = 40
N_FEATURES = 23

# Possessive forms of the plain patterns: equal matches without deep recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?)"
DIGIT, BRACKETS, AT_SIGN, DOT_WORD, COLON, PLUS = "0-9", "[({<", "@", ("dot", "DOT"), ":", "+"
# What a text must hold for a pattern to match at all: a digit, or one of these strings.
BASE_NEEDS = {"email": AT_SIGN, "ip": DIGIT, "card": DIGIT, "phone": PLUS}
# Kind, need and pattern of each generator; they may overlap.
GENERATORS = [
    ("email", BRACKETS, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\.|\sdot\s)[A-Za-z0-9-]++){{1,8}}+"),
    ("email", DOT_WORD, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s(?:at|AT)\s[A-Za-z0-9-]++(?:\s(?:dot|DOT)\s[A-Za-z0-9-]++){1,8}+"),
    ("email", AT_SIGN, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?@\s?[A-Za-z0-9-]++(?:\s?\.\s?[A-Za-z0-9-]++){1,8}+"),
    ("email", AT_SIGN, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+@[A-Za-z0-9-]++(?:(?:{_DOT}|\sdot\s)[A-Za-z0-9-]++){{1,8}}+"),
    ("ip", DIGIT, rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\sdot\s|\s\.\s)[0-9]{{1,3}}){{3}}(?![0-9])"),
    ("ip", COLON, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card", DIGIT, r"(?<![0-9A-Za-z])[0-9]{4}(?:[\s._/-]{1,3}[0-9]{4}){3}(?![0-9A-Za-z])"),
    ("card", DIGIT, r"(?<![0-9A-Za-z])3[0-9]{3}[\s.-]?[0-9]{6}[\s.-]?[0-9]{4,5}(?![0-9A-Za-z])"),
    ("card", DIGIT, r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("phone", DIGIT, r"(?<![0-9A-Za-z.+])\(?[2-9][0-9]{2}\)?[\s./-]{1,2}[0-9]{3}[\s./-][0-9]{4}(?![0-9A-Za-z])"),
    ("phone", DIGIT, r"(?<![0-9A-Za-z.])(?:00|1[\s.-])[\s(]{0,2}[0-9](?:[\s().-]{0,2}[0-9]){7,14}+(?![0-9A-Za-z])"),
    ("phone", PLUS, r"\+\s[0-9](?:[\s().-]{0,2}[0-9]){7,14}+"),
]
KEYWORDS = {
    "email": "mail|contact|write|reach|address|kontakt|correo|courriel",
    "ip": r"\bip\b|addr|host|server|login|client|adresse",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta|pay",
    "phone": "phone|call|tel|mobile|cell|fax|contact|ring|dial|anruf|appel|llam",
}
AGAINST = "isbn|version|order|invoice|serial|page|figure|part|sku|ref|no\\.|number|build|issue|doi"
SPAN = ["kind", "start", "end", "value"]
SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, not once per use or element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block_size(items: Column) -> Column:
    """Items are searched in blocks of about the root of their number: n to the 1.5 steps for n searches."""
    return F.ceil(F.sqrt(F.size(items))).cast("int")


def blocks(items: Column, size: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` each block of items."""
    first = F.sequence(F.lit(1), F.size(items), size)
    return F.when(F.size(items) > 0, F.transform(first, lambda i: of(F.slice(items, i, size))))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def starts_of(lengths: Column, size: Column) -> Column:
    """Sum of all lengths before each block."""
    return F.aggregate(
        blocks(lengths, size, total), F.array(F.lit(0)),
        lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))


def found(text: Column, kind: int, pattern: str) -> Column:
    """All matches with their places, from the matches and the gaps between them."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def placed(items: Column, lengths: Column, size: Column, sums: Column) -> Column:
        def span(item: Column, i: Column) -> Column:
            inside = total(F.slice(lengths, i - i % size + 1, i % size))
            start = F.get(sums, (i / size).cast("int")) + inside + F.length(item["gap"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"),
                            (start + F.length(item["value"])).alias("end"), item["value"].alias("value"))
        return F.filter(F.transform(items, span), lambda s: s["value"].isNotNull())

    def length(item: Column) -> Column:
        return F.length(item["gap"]) + F.coalesce(F.length(item["value"]), F.lit(0))

    walked = let(zipped, lambda items: let(F.transform(items, length), lambda lengths: let(
        block_size(lengths), lambda size: let(
            starts_of(lengths, size), lambda sums: placed(items, lengths, size, sums)))))
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(SPANS))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def octets(value: Column) -> Column:
    """All numbers in a value are at most 255."""
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & ((bare == "") | (bare.cast("int") <= 255))
    return F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), small)


def valid(kind: int, value: Column) -> Column:
    count = F.length(digits(value))
    return {
        "email": F.lit(True), "ip": octets(value),
        "card": F.when(count.between(16, 19), luhn(value)).otherwise(F.lit(False)),
        "phone": count.between(8, 15)}[KINDS[kind]]


def gated(text: Column, patterns: list[tuple[int, str | tuple, str]], pick=None) -> Column:
    """Spans of (kind, need, pattern) in that order; patterns whose need the text lacks are not tried."""
    groups: dict = {}
    for kind, need, pattern in patterns:
        groups.setdefault(need, []).append((kind, pattern))
    parts = []
    for need, own in groups.items():
        there = F.regexp_like(text, F.lit("[0-9]")) if need == DIGIT else reduce(
            or_, (F.contains(text, F.lit(x)) for x in need))
        spans = F.concat(*[pick(k, found(text, k, p)) if pick else found(text, k, p) for k, p in own])
        parts.append(F.when(there, spans).otherwise(F.array().cast(SPANS)))
    return F.concat(*parts)


def base_spans(text: Column) -> Column:
    def checked(kind: int, spans: Column) -> Column:
        return F.filter(spans, lambda s: valid(kind, s["value"]))
    return gated(text, [(k, BASE_NEEDS[name], BASE[name]) for k, name in enumerate(KINDS)], checked)


# A long text is looked into by pieces: to cut from a text, Spark walks it from its start.
PIECE = 512


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """At most PIECE code points of a text given by its pieces."""
    at = (start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(parts, at), F.lit("")), F.coalesce(F.get(parts, at + 1), F.lit("")))
    return F.substring(two, start % PIECE + 1, length)


def features(parts: Column, span: Column) -> list[Column]:
    """Numbers that describe a span of the text with these ``pieces``."""
    value, start = span["value"], span["start"]
    low = F.lower(value)
    first = F.greatest(start - CONTEXT, F.lit(0))
    before = F.lower(cut(parts, first, start - first))
    after = cut(parts, span["end"], F.lit(1))
    count = F.length(digits(value))
    words = F.when(span["kind"] == 0, before.rlike(KEYWORDS["email"]))
    for k in range(1, 4):
        words = words.when(span["kind"] == k, before.rlike(KEYWORDS[KINDS[k]]))
    sums = F.when(count.between(12, 19), luhn(value)).otherwise(F.lit(False))
    flags = [span["kind"] == k for k in range(4)] + [
        sums, octets(value), words, before.rlike(AGAINST),
        low.rlike(r"[\[({<]\s?(at|@)\s?[\])}>]"), low.rlike(r"[\[({<]\s?(dot|\.)\s?[\])}>]|\sdot\s"),
        low.rlike(r"[.\s\])}>](com|org|net|edu|gov|io|info|de|fr|es|uk|eu|co)$"),
        low.rlike(r"^\s?@|\s@|@\s"), value.rlike(r"\("), value.rlike(r"^(00|\+|1[\s.-])"),
        value.rlike(r"^[3-6]"), after.rlike(r"[0-9A-Za-z%$]"), before.rlike(r"[=#:/\"$%]\s?$"),
        value.rlike(":"), value.rlike(r"\n")]
    numbers = [count, F.length(value), F.length(F.regexp_replace(value, r"[^\s._/-]", "")),
               F.size(F.array_distinct(F.transform(
                   F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), F.length)))]
    return [F.coalesce(f.cast("double"), F.lit(0.0)) for f in [*flags, *numbers]]


def without_touched(spans: Column, others: Column, beats: Callable[[Column, Column], Column]) -> Column:
    """Spans that no overlapping one of ``others`` (sorted by start) ``beats``."""
    def touches(span: Column, size: Column, reach: Column) -> Column:
        def in_block(block: Column) -> Column:
            near = (block["low"] < span["end"]) & (span["start"] < block["high"])
            return near & F.exists(
                F.slice(others, block["first"], size),
                lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]) & beats(o, span))
        return F.exists(reach, in_block)

    def extent(size: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(others), size)
        return F.when(F.size(others) > 0, F.transform(first, lambda i: F.struct(
            i.alias("first"), F.element_at(others, i)["start"].alias("low"),
            F.array_max(F.transform(F.slice(others, i, size), lambda o: o["end"])).alias("high"))))

    kept = let(block_size(others), lambda size: let(
        extent(size), lambda reach: F.filter(spans, lambda s: ~touches(s, size, reach))))
    return F.when(F.size(others) > 0, kept).otherwise(spans)


def by_start(spans: Column) -> Column:
    """Spans sorted by start, with the fields in another order."""
    return F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def proposals(text: Column, base: Column) -> Column:
    """Proposed spans that do not touch a base span, each once."""
    every = F.sort_array(gated(text, [(KINDS.index(k), need, p) for k, need, p in GENERATORS]))
    once = let(every, lambda spans: F.filter(
        spans, lambda s, i: (i == 0) | (F.get(spans, i - 1) != s)))
    return let(once, lambda spans: let(by_start(base), lambda others: without_touched(
        spans, others, lambda o, s: F.lit(True))))


def examples(seed: int = 11, times: int = 60) -> list[tuple[str, int]]:
    """Labelled texts, each with one proposal: 1 if it is personal data."""
    rng = random.Random(seed)
    names, hosts = ["jane.doe", "k_miller", "info", "p.schmidt7", "ana"], ["mail", "web-post", "uni", "corp"]
    ends = ["com", "org", "net", "de", "fr", "es", "io"]
    filler = ["the of and to", "on the other side", "und der die das", "que la de los", "is in a that"]
    asks = {"email": "contact mail", "ip": "host ip address", "card": "card payment visa",
            "phone": "call phone tel"}
    against = ["order no.", "isbn", "version", "invoice number", "part ref", "page", "serial"]

    def number(n: int, first: str = "123456789") -> str:
        return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))

    def check(body: str) -> str:
        total = 0
        for i, c in enumerate(reversed(body)):
            d = int(c) * (2 - i % 2)
            total += d - 9 if d > 9 else d
        return body + str(-total % 10)

    def spaced(s: str, *cuts: int, by: str = " ") -> str:
        return by.join(s[a:b] for a, b in zip((0, *cuts), (*cuts, len(s)), strict=True))

    out = []
    for _ in range(times):
        name, host, end = rng.choice(names), rng.choice(hosts), rng.choice(ends)
        part = [str(rng.randrange(256)) for _ in range(4)]
        good = check(number(15, "3456"))
        bad = good[:-1] + str((int(good[-1]) + rng.randrange(1, 9)) % 10)
        phone = number(3, "23456789"), number(3, "23456789"), number(4)
        hexes = ":".join(f"{rng.randrange(65536):x}" for _ in range(8))
        yes = [
            ("email", f"{name} [at] {host} [dot] {end}"), ("email", f"{name}(at){host}.{end}"),
            ("email", f"{name} at {host} dot {end}"), ("email", f"{name} @ {host} . {end}"),
            ("email", f"{name}@{host}[dot]{end}"), ("email", f"{name} [at] {host}.{end}"),
            ("ip", "[.]".join(part)), ("ip", " dot ".join(part)), ("ip", hexes),
            ("card", spaced(good, 4, 8, 12, by=rng.choice([".", "  ", "/", " - "]))),
            ("card", spaced(check("3" + rng.choice("47") + number(12)), 4, 10)),
            ("card", check("3" + rng.choice("47") + number(12))),
            ("phone", "({}) {}-{}".format(*phone)), ("phone", "-".join(phone)),
            ("phone", ".".join(phone)), ("phone", "00{} {} {}".format(number(2), number(3), number(6))),
            ("phone", "1-" + "-".join(phone)), ("phone", "+ 1 ({}) {}-{}".format(*phone))]
        no = [
            ("email", f"{rng.choice(names)} @ {number(2)} . {number(2)}"),
            ("email", f"{rng.choice(['it', 'was', 'look'])} at {rng.choice(['the', 'a'])} dot of"),
            ("ip", " . ".join([*part[:3], str(rng.randrange(300, 999))])),
            ("card", bad), ("card", spaced(bad, 4, 8, 12, by=rng.choice([".", "/", " - "]))),
            ("card", number(14)), ("card", number(19)), ("card", "3" + number(14)),
            ("phone", "{}/{} {}".format(number(3, "23456789"), number(3), number(4)) + "%"),
            ("phone", "00" + number(13)), ("phone", "1 " + number(14))]
        for (kind, value), label in [*((y, 1) for y in yes), *((n, 0) for n in no)]:
            lead = rng.choice(filler)
            if rng.random() < (0.4 if label else 0.1):
                lead += " " + rng.choice(asks[kind].split())
            if not label and rng.random() < 0.5:
                lead += " " + rng.choice(against)
            out.append((f"{lead} {value} {rng.choice(filler)}", label))
    return out


def described_spans(text: Column, spans: Column) -> Column:
    """(span, x) of each span; x are its features."""
    return let(pieces(text), lambda parts: F.transform(spans, lambda s: F.struct(
        s.alias("span"), F.array(*features(parts, s)).alias("x"))))


def fit(docs: DataFrame, limit: int = MAX_TRAINING_ROWS) -> tuple[trees.Trees, list[float]]:
    """Trees and the threshold of each kind, as margins."""
    spark = docs.sparkSession

    def described(rows: DataFrame, *keep: str) -> DataFrame:
        spans = rows.withColumn("base", base_spans(F.col("text")))
        return spans.select(*keep, F.inline(described_spans(F.col("text"), proposals(F.col("text"), F.col("base")))))

    # Documents are chosen by their hash first, so that the patterns run over few of them.
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = texts.select(F.xxhash64("text").alias("body")).distinct().orderBy("body").limit(MAX_TRAINING_TEXTS)
    chosen = texts.withColumn("body", F.xxhash64("text")).join(
        F.broadcast(picked), "body", "left_semi").dropDuplicates(["body"]).select("text")
    made = described(spark.createDataFrame(examples(), "text string, label int"), "label")
    own = described(chosen)
    card, ip, value = F.col("span.kind") == 2, F.col("span.kind") == 1, F.col("span.value")
    weak = F.when(card, F.when(F.length(digits(value)).between(13, 19), luhn(value)).otherwise(False)) \
        .when(ip, octets(value) | value.rlike(":"))
    own = own.withColumn("label", weak.cast("int")).where("label is not null").orderBy(
        F.xxhash64("span", "x"), "x").limit(limit)
    rows = [(r.span.kind, r.label, r.x) for r in [
        *made.orderBy(F.xxhash64("span"), "x").limit(limit).collect(), *own.select("label", "span", "x").collect()]]
    kind, y, x = (np.array(c, float) for c in zip(*rows, strict=True))
    held = np.arange(len(y)) % 3 == 0
    assert x.shape[1] == N_FEATURES
    model = trees.fit(x[~held], y[~held], rounds=30, depth=3)
    margin, limits = model.margins(x), []
    for k in range(len(KINDS)):
        of = held & (kind == k)
        order = np.argsort(-margin[of])
        right = np.cumsum(y[of][order]) / np.arange(1, of.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits.append(max(0.0, float(margin[of][order][good[-1]]) - 1e-9) if len(good) else np.inf)
    return model, limits


def redactions(docs: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents (null text as empty) with ``base`` and ``spans``: arrays of kind, start, end, value."""
    model, limits = fit(docs, limit)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scored = docs.withColumn("text", text).withColumn("base", base_spans(F.col("text")))
    scored = scored.withColumn("_proposed", proposals(F.col("text"), F.col("base")))

    def rated(seen: Column) -> Column:
        span = seen["span"]
        limit_of = F.element_at(F.array(*[F.lit(float(min(x, 1e9))) for x in limits]), span["kind"] + 1)
        margin = model.column([seen["x"][k] for k in range(N_FEATURES)])
        return F.struct(*[span[c].alias(c) for c in SPAN], (margin - limit_of).alias("over"))

    scored = scored.withColumn("_seen", F.when(
        F.size("_proposed") > 0, described_spans(F.col("text"), F.col("_proposed")))).withColumn(
        "_rated", F.filter(F.transform("_seen", rated), lambda s: s["over"] >= 0))

    def beats(o: Column, span: Column) -> Column:
        return (o["over"] > span["over"]) | ((o["over"] == span["over"]) & (
            F.struct(o["start"], o["end"], o["kind"]) < F.struct(span["start"], span["end"], span["kind"])))

    ordered = F.sort_array(F.transform("_rated", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"),
        s["over"].alias("over"))))
    best = let(ordered, lambda spans: without_touched(spans, spans, beats))
    added = F.transform(F.when(F.size("_rated") > 0, best), lambda s: F.struct(*[s[c].alias(c) for c in SPAN]))
    return scored.withColumn(
        "spans", F.sort_array(F.concat("base", F.coalesce(added, F.array().cast(SPANS))))).drop(
        "_proposed", "_seen", "_rated")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*map(F.lit, KINDS))
    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                            .otherwise(b["end"] - a["end"]))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(
                state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]),
                F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")))
            .otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(by_place, begin, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))
