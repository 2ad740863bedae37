"""Marker tables: structured full-text expressions and their validity.

An expression is a list of clauses that all have to hold. A clause holds if one of its atoms
hits (or, negated, if none does). Atom kinds: ``term``, ``prefix``, ``phrase``,
``phrase_prefix`` (prefix on the last token), ``first`` (at the start of the text) and
``near`` (two or more phrases inside a stretch with at most ``k`` tokens between them).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.sql import text_list
from postlens.functions.text import tokens
from postlens.schema import MARKER_SCHEMA
from postlens.sources.layout import settled

KINDS = ["term", "prefix", "phrase", "phrase_prefix", "first", "near"]
DEFAULT_GAP = 10
# Up to this many (marker, key) pairs the marker table is carried into every task.
SMALL_MARKERS = 20_000
# What of a larger table is sent to all tasks at a time: keys with their markers, and phrases.
PART_KEYS, PART_BYTES = 200_000, 64 << 20


# --- writing markers -----------------------------------------------------------------


def atom(kind: str, *parts: str, k: int | None = None) -> tuple:
    return kind, list(parts), k


def all_of(*clauses: tuple) -> list[tuple]:
    return list(clauses)


def any_of(*atoms: tuple) -> tuple:
    return False, list(atoms)


def none_of(*atoms: tuple) -> tuple:
    return True, list(atoms)


_ATOM = pa.struct([
    ("kind", pa.string()), ("tokens", pa.list_(pa.string())), ("k", pa.int32())])
_CLAUSE = pa.struct([("negated", pa.bool_()), ("atoms", pa.list_(_ATOM))])
_TEXTS = ["index", "platform", "category", "type", "marker_title", "marker_group", "fts_query"]


def marker_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Marker rows given in the program, in the order of ``MARKER_SCHEMA``."""
    columns = {name: pa.array([r[i] for r in rows], pa.string()) for i, name in enumerate(_TEXTS)}
    columns["to_analyse"] = pa.array([r[7] for r in rows], pa.int32())
    clauses = [[
        {"negated": negated, "atoms": [dict(zip(("kind", "tokens", "k"), a)) for a in atoms]}
        for negated, atoms in r[8]] for r in rows]
    columns["clauses"] = pa.array(clauses, pa.list_(_CLAUSE))
    return spark.createDataFrame(pa.table(columns))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker table stored as JSON lines."""
    return spark.read.schema(MARKER_SCHEMA).json(path)


# --- preparing markers ---------------------------------------------------------------


def _phrase(words: str, place: str, group: str) -> str:
    """One phrase of atom ``a`` in clause ``c``; ``key`` is what a post offers as first token.

    ``group`` is the number of phrases of a near atom (0 for others), ``place`` the place in it.
    """
    first = f"get({words}, 0)"
    prefix = "a.kind in ('prefix', 'phrase_prefix')"
    return f"""named_struct(
        'clause', c.no, 'negated', c.negated, 'words', {words}, 'm', size({words}),
        'prefix', {prefix}, 'first', a.kind = 'first', 'place', {place}, 'group', {group},
        'k', coalesce(a.k, {DEFAULT_GAP}),
        'key', if({prefix} and size({words}) = 1,
            concat(char_length({first}), '*', {first}), concat('=', {first})))"""


# Clauses with their number, every part of an atom cut into tokens.
TOKENIZED = f"""
    transform(clauses, (c, no) -> struct(no as no, c.negated as negated,
        transform(c.atoms, a -> struct(a.kind as kind, a.k as k,
            transform(a.tokens, t -> {tokens('t')}) as parts)) as atoms))"""

# All phrases of a marker in one list; the parts of a near atom follow one another.
PHRASES = f"""
    flatten(transform(tokenized, c -> flatten(transform(c.atoms, a -> if(a.kind = 'near',
        transform(a.parts, (words, n) -> {_phrase('words', 'n', 'size(a.parts)')}),
        array({_phrase('flatten(a.parts)', '0', '0')}))))))"""

_ATOM_PROBLEM = f"""
    case when coalesce(a.kind not in ({text_list(KINDS)}), true) then 'unknown kind'
        when coalesce(size(flatten(a.parts)), 0) < 1
            or (a.kind = 'near' and exists(a.parts, p -> size(p) = 0)) then 'no tokens'
        when a.kind = 'near' and size(a.parts) < 2 then 'near needs two parts'
        when a.kind = 'near' and a.k < 0 then 'negative gap' end"""

# Why a marker cannot be evaluated, null if it can.
PROBLEM = f"""
    case when index is null then 'no index'
        when count(*) over (partition by index) > 1 then 'index repeated'
        when platform is null then 'no platform'
        when coalesce(size(tokenized), 0) < 1 then 'no clauses'
        when forall(tokenized, c -> c.negated) then 'only negated clauses'
        when exists(tokenized, c -> coalesce(size(c.atoms), 0) < 1) then 'empty clause'
        else get(array_compact(transform(flatten(transform(tokenized, c -> c.atoms)),
            a -> {_ATOM_PROBLEM})), 0) end"""


@dataclass(frozen=True)
class KeyFilter:
    """Which of ``buckets`` hash values the keys of a marker table have, seven to a byte.

    A byte stays below 128, so it can be read as one ASCII character.
    """

    buckets: int
    bits: bytes
    lengths: tuple[int, ...]

    def _keys(self, token: str) -> list[tuple[str, str]]:
        """SQL: when a token has a key, and the key."""
        return [("true", f"concat('=', {token})")] + [
            (f"char_length({token}) >= {n}", f"concat('{n}*', left({token}, {n}))") for n in self.lengths]

    def _held(self, key: str) -> str:
        place = f"pmod(xxhash64({key}), {self.buckets}L)"
        byte = f"ascii(cast(substring(X'{self.bits.hex()}', cast({place} div 7 as int) + 1, 1) as string))"
        return f"bit_get({byte}, cast({place} % 7 as int)) = 1"

    def any_offered(self, token: str) -> str:
        """SQL: may the marker table hold a key of the token? Most tokens stop here, and no array is made for them."""
        return " or ".join(f"({has} and {self._held(key)})" for has, key in self._keys(token))

    def offered(self, token: str) -> str:
        """SQL: the keys of a token that the marker table may hold."""
        keys = [f"if({has}, {key}, null)" for has, key in self._keys(token)]
        return f"filter(array({', '.join(keys)}), k -> k is not null and {self._held('k')})"


@dataclass(frozen=True)
class Markers:
    """Markers to analyse: ``rows`` all of them, ``specs`` the valid ones as phrase lists.

    A large table has ``parts``, each with a filter over its own keys.
    """

    rows: DataFrame
    specs: DataFrame
    small: bool
    words: tuple[str, ...] = ()
    prefixes: tuple[tuple[int, tuple[str, ...]], ...] = ()
    platforms: tuple[str, ...] = ()
    parts: tuple[Markers, ...] = ()
    filter: KeyFilter | None = None

    @property
    def keys(self) -> DataFrame:
        """(key, marker) for every key that makes a post a candidate."""
        return self.specs.select(F.explode("wanted").alias("key"), "marker")


def key_filter(specs: DataFrame) -> KeyFilter:
    """A filter of the keys of all phrases, negated ones too; a row for each used byte comes to the driver."""
    keys = specs.selectExpr("explode(transform(phrases, p -> p.key)) as key").distinct()
    buckets = 7 * (2 * keys.count() + 1)
    bytes_ = (
        keys.selectExpr(f"pmod(xxhash64(key), {buckets}L) as h")
        .groupBy(F.expr("h div 7").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(h % 7 as int))")).alias("bits")))
    bits = bytearray(buckets // 7)
    for row in bytes_.collect():
        bits[row["at"]] = row["bits"]
    lengths = keys.where("key not like '=%'").selectExpr("cast(substring_index(key, '*', 1) as int) as n").distinct()
    return KeyFilter(buckets, bytes(bits), tuple(sorted(row.n for row in lengths.collect())))


def _parts(rows: DataFrame, specs: DataFrame) -> tuple[Markers, ...]:
    """The markers in parts of about PART_KEYS keys and PART_BYTES of phrases, dealt by a hash."""
    keys, size = specs.selectExpr(
        "size(wanted) as keys", "octet_length(to_json(struct(phrases, wanted))) as size"
    ).agg(F.sum("keys"), F.sum("size")).first()
    n = max(-(-keys // PART_KEYS), -(-size // PART_BYTES))
    parts = [specs.where(F.pmod(F.xxhash64("marker"), F.lit(n)) == k) for k in range(n)]
    return tuple(Markers(rows, part, small=False, filter=key_filter(part)) for part in parts)


def prepare(markers: DataFrame, limit: int = SMALL_MARKERS) -> Markers:
    """Check and flatten the markers that are to be analysed.

    At most ``limit`` + 1 keys come to the driver. If there are more, the tables stay
    distributed, in parts that are small enough to be sent to all tasks.
    """
    checked = settled(
        markers.where("to_analyse = 1")
        .selectExpr("*", f"{TOKENIZED} as tokenized")
        .selectExpr("*", f"{PROBLEM} as problem")
        .selectExpr(
            "* except (tokenized, clauses)",
            "transform(clauses, c -> c.negated) as negations",
            f"if(problem is null, {PHRASES}, null) as phrases")
    )
    rows = checked.drop("phrases", "negations")
    specs = checked.where("problem is null").selectExpr(
        "index as marker", "platform as marker_platform", "negations", "phrases",
        "array_max(transform(phrases, p -> p.m)) as widest",
        "array_distinct(transform(filter(phrases, p -> not p.negated), p -> p.key)) as wanted",
    )
    pairs = specs.selectExpr("explode(transform(phrases, p -> p.key)) as key")
    found = [row.key for row in pairs.limit(limit + 1).collect()]
    if len(found) > limit:
        return Markers(rows, specs, small=False, parts=_parts(rows, specs))
    words = tuple(sorted({key[1:] for key in found if key.startswith("=")}))
    by_length: dict[int, set[str]] = {}
    for key in found:
        if not key.startswith("="):
            length, _, text = key.partition("*")
            by_length.setdefault(int(length), set()).add(text)
    prefixes = tuple((n, tuple(sorted(texts))) for n, texts in sorted(by_length.items()))
    # A marker has at least one key, so the limit bounds the platforms too.
    platforms = tuple(sorted(
        row.marker_platform for row in specs.select("marker_platform").distinct().collect()))
    return Markers(rows, specs, True, words, prefixes, platforms)
