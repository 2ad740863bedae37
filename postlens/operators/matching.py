"""Match many markers against all posts in one pass.

Each post is cut into tokens once. Tokens that any marker asks for are looked up in a hash set
inside the row; they name the candidate markers, and the markers are then evaluated on the
post's own arrays. Nothing is shuffled before the aggregation of the results. A marker table too
large for a list of its tokens is met in parts, each with a hash filter of its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import text
from postlens.functions.sql import let, text_list, text_literal, upto
from postlens.schema import REFERENCE_PREFIX
from postlens.sources.markers import Markers


def length() -> str:
    """SQL: tokens of subject, body and extras together."""
    return " + ".join(text.count(c) for c in ("subject", "body", "extras"))


def with_length(posts: DataFrame) -> DataFrame:
    """Add ``dl``; stored posts bring it along."""
    return posts if "dl" in posts.columns else posts.selectExpr("*", f"{length()} as dl")


def with_tokens(posts: DataFrame) -> DataFrame:
    """Add ``tokens`` of the body, and ``dl``, for which the body is not cut again."""
    cut = posts.selectExpr("*", f"{text.tokens('body')} as tokens")
    if "dl" in posts.columns:
        return cut
    return cut.selectExpr("*", f"size(tokens) + {text.count('subject')} + {text.count('extras')} as dl")


# --- candidates ----------------------------------------------------------------------


def _small_candidates(posts: DataFrame, markers: Markers) -> DataFrame:
    """Keep the asked-for tokens of a post as ``spots`` and look their keys up in the markers."""
    asked = [f"t in ({text_list(markers.words)})"] if markers.words else []
    asked += [f"left(t, {n}) in ({text_list(texts)})" for n, texts in markers.prefixes]
    spots = (
        "array_compact(transform(tokens, (t, i) -> "
        f"if({' or '.join(asked) or 'false'}, struct(i as i, t as t), null)))"
    )
    keys = ["concat('=', s.t)"]
    keys += [f"concat('{n}*', left(s.t, {n}))" for n, _ in markers.prefixes]
    candidates = (
        posts.selectExpr("*", f"{spots} as spots")
        .selectExpr("*", f"array_distinct(flatten(transform(spots, s -> array({', '.join(keys)})))) as offered")
        # Exploding a bare column would add a filter that repeats its whole computation.
        .selectExpr("*", "explode(array_distinct(offered)) as key")
        .join(F.broadcast(markers.keys), "key")
        .join(F.broadcast(markers.specs), "marker")
    )
    return _first_key(candidates)


def _large_candidates(posts: DataFrame, markers: Markers) -> DataFrame:
    """Like ``_small_candidates``, but a filter tells inside the row which keys may be asked for.

    A table of any size is met in parts that are sent to all tasks, one pass of the tokens for
    each; texts and tokens are never shuffled.
    """
    parts = []
    for part in markers.parts:
        own = f"struct(i as i, {part.filter.offered('t')} as own)"
        spots = f"array_compact(transform(tokens, (t, i) -> if({part.filter.any_offered('t')}, {own}, null)))"
        candidates = (
            posts.selectExpr("*", f"{spots} as spots")
            .selectExpr("*", "array_distinct(flatten(transform(spots, s -> s.own))) as offered")
            # As above: exploding the bare column would compute everything below it twice.
            .selectExpr("*", "explode(array_distinct(offered)) as key")
            .join(F.broadcast(part.keys), "key")
            .join(F.broadcast(part.specs), "marker"))
        parts.append(_first_key(candidates))
    return reduce(DataFrame.unionByName, parts)


def _first_key(candidates: DataFrame) -> DataFrame:
    """A post that offers several keys of a marker keeps the first pair only."""
    return (
        candidates.where("get(array_intersect(offered, wanted), 0) = key")
        .withColumn("spots", F.expr("transform(spots, s -> s.i)"))
        .drop("offered", "key", "wanted")
    )


# --- evaluation ----------------------------------------------------------------------


def _word_at(phrase: str, offset: str, position: str) -> str:
    token, word = f"get(tokens, {position})", f"get({phrase}.words, {offset})"
    return (f"coalesce(if({phrase}.prefix and {offset} = {phrase}.m - 1, "
            f"startswith({token}, {word}), {token} = {word}), false)")


def _hits_at(phrase: str, position: str) -> str:
    """Does the phrase start at this token?"""
    rest = f"forall({upto(1, f'{phrase}.m - 1')}, d -> {_word_at(phrase, 'd', f'{position} + d')})"
    return (f"((not {phrase}.first or {position} = 0) and {_word_at(phrase, '0', position)} "
            f"and ({phrase}.m = 1 or {rest}))")


# Start positions of every phrase, as one array per phrase.
_STARTS = f"transform(phrases, p -> filter(spots, i -> {_hits_at('p', 'i')}))"

# Starts that count: those of a near group only if some start of the group, at or behind this
# one, is the last of a set with every phrase of the group at most k tokens before it.
_OWN, _OTHER = "get(phrases, no)", "get(phrases, other)"
_GROUP = f"sequence(no - {_OWN}.place, no - {_OWN}.place + {_OWN}.group - 1)"
_BEFORE = upto(f"greatest(0, last - {_OTHER}.m - {_OWN}.k)", "last")
_NEAR = f"""exists({upto('i', f'i + {_OWN}.m + {_OWN}.k')}, last ->
    exists({_GROUP}, other -> {_hits_at(_OTHER, 'last')})
    and forall({_GROUP}, other -> exists({_BEFORE}, j -> {_hits_at(_OTHER, 'j')})))"""
_KEPT = f"""transform(starts, (x, no) -> if({_OWN}.group = 0, x, filter(x, i -> {_NEAR})))"""

_HOLDS = f"""forall(transform(negations, (negated, clause) -> negated <> exists(
    {upto(0, 'size(phrases) - 1')},
    no -> get(phrases, no).clause = clause and size(get(kept, no)) > 0)), ok -> ok)"""

# Marked spans: hits that share a token merge, neighbours do not. ``hits`` holds the longest hit
# per start; only hits within the widest phrase can reach one another.
_ORDERED = """sort_array(flatten(transform(kept, (x, no) -> if(get(phrases, no).negated,
    cast(array() as array<struct<s: int, e: int>>),
    transform(x, i -> struct(i as s, i + get(phrases, no).m - 1 as e))))))"""
_LONGEST = "filter(ordered, (h, no) -> not (get(ordered, no + 1).s <=> h.s))"
_SPAN_STARTS = f"""transform(filter(hits, (h, no) -> not exists(
    {upto(1, 'least(no, widest - 1)')}, d -> get(hits, no - d).e >= h.s)), h -> h.s)"""
_SPAN_ENDS = f"""array_distinct(transform(filter(hits, (h, no) -> not exists(
    {upto('greatest(0, no - widest + 1)', 'no + widest - 1')},
    j -> coalesce(get(hits, j).s <= h.e and get(hits, j).e > h.e, false))), h -> h.e))"""


def _result(with_ends: bool) -> str:
    ends = _SPAN_ENDS if with_ends else "cast(array() as array<int>)"
    spans = let("ordered", _ORDERED, let(
        "hits", _LONGEST, f"struct({_SPAN_STARTS} as starts, {ends} as ends)"))
    return let("starts", _STARTS, let("kept", _KEPT, f"""struct(
        {_HOLDS} as holds,
        transform(starts, x -> size(x) > 0) as seen,
        transform(kept, x -> size(x)) as f,
        {spans} as spans)"""))


def evaluate(candidates: DataFrame, with_ends: bool = False) -> DataFrame:
    """Add ``result`` (holds, seen, f, spans) to (post, marker) candidates.

    ``seen`` tells per phrase whether it occurs at all, ``f`` how many of its hits count.
    """
    return candidates.selectExpr("*", f"explode(array({_result(with_ends)})) as result")


def in_scope() -> Column:
    """Post of the marker's own platform or of that platform's reference dataset."""
    reference = F.concat(F.lit(REFERENCE_PREFIX), "marker_platform")
    return (F.col("platform") == F.col("marker_platform")) | (F.col("platform") == reference)


def match(
    posts: DataFrame, markers: Markers, keep: list[str],
    with_ends: bool = False, scoped: bool = False,
) -> DataFrame:
    """Candidates with their result; ``keep`` names the post columns to carry along.

    ``scoped`` drops posts of platforms that no marker asks for before they are read, and those
    of other platforms than the marker's before they are evaluated.
    """
    if scoped and markers.small:
        wanted = [name for p in markers.platforms for name in (p, REFERENCE_PREFIX + p)]
        posts = posts.where(F.col("platform").isin(wanted))
    needed = ["uid", *keep, *(["platform"] if scoped else []), "tokens"]
    counted = with_tokens(posts) if "dl" in keep else posts.selectExpr(
        "*", f"{text.tokens('body')} as tokens")
    narrow = counted.select(*dict.fromkeys(needed))
    find = _small_candidates if markers.small else _large_candidates
    candidates = find(narrow, markers)
    if scoped:
        candidates = candidates.where(in_scope())
    return evaluate(candidates, with_ends).drop("tokens", "spots")


def hits(
    posts: DataFrame, markers: Markers, keep: list[str],
    with_ends: bool = False, scoped: bool = False,
) -> DataFrame:
    """Posts that match, one row per (post, marker), with the number of spans."""
    return (
        match(posts, markers, keep, with_ends, scoped)
        .where(F.col("result.holds"))
        .withColumn("spans", F.size("result.spans.starts"))
    )


def marked_up(body: str, spans: str, open_tag: str, close_tag: str) -> Column:
    """Body with a tag pair around each span, in time that grows with the text only.

    The text is cut into words and gaps, which take turns. Pieces are joined by the span: the pieces
    between two spans and those of a span are slices, so no piece is looked at by itself.
    """
    opening, closing = text_literal(open_tag), text_literal(close_tag)

    def joined(first: str, length: str) -> str:
        return f"array_join(slice(pieces, {first} + 1, {length}), '')"

    def at(place: str) -> str:
        return f"(2 * {place} + lead)"

    start, end = at("s"), at(f"get({spans}.ends, n)")
    behind = f"if(n = 0, 0, {at(f'get({spans}.ends, n - 1)')} + 1)"  # the first piece behind the span before
    marked = f"""concat(array_join(transform({spans}.starts, (s, n) -> concat(
        {joined(behind, f'{start} - {behind}')}, {opening}, {joined(start, f'{end} - {start} + 1')}, {closing})), ''),
        {joined(f"coalesce({at(f'get({spans}.ends, size({spans}.ends) - 1)')} + 1, 0)", 'size(pieces)')})"""
    leads_with_gap = f"if(get(pieces, 0) rlike r'^[{text.TOKEN_CHARS}]', 0, 1)"
    return F.expr(let("pieces", text.pieces(body), let("lead", leads_with_gap, marked)))
