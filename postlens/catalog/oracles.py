"""The same results as plain SQL for the checking engine, one text per query name.

``WITH`` pieces are kept by name and prefixed with whatever they build on.
"""

from __future__ import annotations

from postlens.catalog import fixtures as fx
from postlens.catalog import registry as reg
from postlens.schema import CLOSE_TAG, FULL_VIEW, MATCH_VIEW, META_VIEW, OPEN_TAG

WORD = r"[\p{L}\p{N}\p{Co}]+"
GAP = r"[^\p{L}\p{N}\p{Co}]+"
KEY = "platform, board, post_type, post_id, epoch"


def _tokens(column: str) -> str:
    folded = f"strip_accents(lower({column}))"
    return (f"coalesce(list_filter(regexp_split_to_array({folded}, '{GAP}'), lambda x: x <> ''), "
            "cast([] as varchar[]))")


def _epoch(iso: str) -> str:
    return f"cast(epoch(timestamp '{iso.replace('T', ' ')}') as bigint)"


def _day(epoch: str) -> str:
    return f"strftime(make_timestamp(({epoch}) * 1000000), '%Y-%m-%d')"


def _names(columns: list[str], table: str = "") -> str:
    dot = f"{table}." if table else ""
    return ", ".join(f"{dot}epoch" if c == "timestamp" else f"{dot}{c}" for c in columns)


# --- shared pieces -------------------------------------------------------------------

PIECES: dict[str, tuple[list[str], str]] = {
    name: ([], fx.duck_sql(name)) for name in fx.RELATIONS
}
PIECES |= {
    "totals": (["fx_posts"], "select platform, count(*) as count_posts from fx_posts group by 1"),
    "weighted": (["totals"], f"""
        select platform, cast(round(sqrt(count_posts) / sum(sqrt(count_posts)) over ()
            * {reg.SAMPLE_TOTAL}) as bigint) as sample_size from totals"""),
    "keyed": (["fx_posts"], f"""
        select uid, platform, row_number() over (partition by platform
            order by md5(concat(uid, ':', {fx.SEED})), uid) as place from fx_posts"""),
    "sample": (["keyed", "weighted"], """
        select k.uid, k.platform from keyed k join weighted w using (platform)
        where place <= sample_size and platform in ('alpha', 'beta')"""),
    "toks": (["fx_posts"], f"""
        select uid, platform, {_tokens('body')} as tokens,
            len({_tokens('body')}) + len({_tokens('subject')}) + len({_tokens('extras')}) as dl
        from fx_posts"""),
    "tok": (["toks"], """
        select uid, platform, unnest(tokens) as t, generate_subscripts(tokens, 1) - 1 as pos
        from toks"""),
    "corpus": (["toks"], "select count(*) as n, sum(dl) / cast(count(*) as double) as avgdl from toks"),
}


def _phrase_hits(kind: str, parts: list[str]) -> str:
    """(uid, pos, len) of one phrase."""
    *whole, last = parts
    ends = kind in ("prefix", "phrase_prefix")
    joins = "".join(
        f" join tok t{i} on t{i}.uid = t0.uid and t{i}.pos = t0.pos + {i}"
        for i in range(1, len(parts)))
    tests = [f"t{i}.t = '{w}'" for i, w in enumerate(whole)]
    tests.append(f"t{len(whole)}.t " + (f"like '{last}%'" if ends else f"= '{last}'"))
    if kind == "first":
        tests.append("t0.pos = 0")
    return (f"select t0.uid, t0.pos, {len(parts)} as len from tok t0{joins} "
            f"where {' and '.join(tests)}")


def _expression(marker: str, clauses: list[tuple]) -> tuple[str, str]:
    """Hits (m, ph, negated, seen, uid, pos, len) and matched posts (m, uid) of one marker.

    ``seen`` rows count for the document frequency, rows with ``kept`` also as hits.
    """
    rows, holds, ph = [], [], 0
    for negated, atoms in clauses:
        tests = []
        for kind, parts, k in atoms:
            words = [p.lower() for p in parts]
            if kind == "near":
                a, b = (_phrase_hits("term", [w]) for w in words)
                k = 10 if k is None else k
                for mine, other in ((a, b), (b, a)):
                    near = (f"exists (select 1 from ({other}) o where o.uid = h.uid "
                            f"and abs(o.pos - h.pos) <= {k + 1})")
                    rows.append(f"select '{marker}' as m, {ph} as ph, {negated} as negated, "
                                f"{near} as kept, h.* from ({mine}) h")
                    tests.append(ph)
                    ph += 1
            else:
                rows.append(f"select '{marker}' as m, {ph} as ph, {negated} as negated, "
                            f"true as kept, h.* from ({_phrase_hits(kind, words)}) h")
                tests.append(ph)
                ph += 1
        inside = ", ".join(str(t) for t in tests)
        found = f"count_if(ph in ({inside}))"
        holds.append(f"{found} = 0" if negated else f"{found} > 0")
    matched = (f"select m, uid from hits where m = '{marker}' and kept group by m, uid "
               f"having {' and '.join(holds)}")
    return " union all ".join(rows), matched


def _marker_pieces(markers: dict[str, list[tuple]]) -> dict[str, tuple[list[str], str]]:
    parts = [_expression(m, clauses) for m, clauses in markers.items()]
    return {
        "hits": (["tok"], " union all ".join(p[0] for p in parts)),
        "matched": (["hits"], " union all ".join(p[1] for p in parts)),
        # Hits that share a token form one island.
        "ordered": (["matched"], """
            select m, uid, pos, pos + len - 1 as stop,
                max(pos + len - 1) over (partition by m, uid order by pos, len
                    rows between unbounded preceding and 1 preceding) as reach
            from hits join matched using (m, uid) where kept and not negated"""),
        "islands": (["ordered"], """
            select m, uid, island, min(pos) as start, max(stop) as stop from (
                select *, sum(case when reach is null or pos > reach then 1 else 0 end)
                    over (partition by m, uid order by pos, stop rows unbounded preceding) as island
                from ordered) group by m, uid, island"""),
        "spans": (["islands"], "select m, uid, count(*) as spans from islands group by m, uid"),
        "idf": (["hits", "corpus"], """
            select m, ph, case when i > 0 then i else 1e-6 end as idf from (
                select m, ph, ln((c.n - count(distinct uid) + 0.5) / (count(distinct uid) + 0.5)) as i
                from hits cross join corpus c group by m, ph, c.n)"""),
        "ranks": (["idf", "matched", "toks"], """
            select m, uid, round(-1 * sum(idf * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 3)
                + 0.0 as rank
            from (select m, ph, uid, count(*) as f from hits where kept group by m, ph, uid)
            join idf using (m, ph) join matched using (m, uid) join toks using (uid)
            cross join corpus group by m, uid"""),
    }


def _with(body: str, *needs: str, markers: dict[str, list[tuple]] | None = None) -> str:
    pieces = PIECES | (_marker_pieces(markers) if markers else {})
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in pieces[name][0]:
                add(need)
            order.append(name)

    for name in needs:
        add(name)
    texts = ", ".join(f"{name} as materialized ({pieces[name][1]})" for name in order)
    return f"with {texts} {body}" if order else body


# --- marker texts --------------------------------------------------------------------

ALL_MARKERS = {row[0]: row[8] for row in fx.MARKERS if row[7] == 1}


def _marker_rows(rows: list[tuple]) -> str:
    def text(value) -> str:
        if value is None:
            return "null"
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    values = ", ".join("(" + ", ".join(text(v) for v in row[:8]) + ")" for row in rows)
    return (f"(select * from (values {values}) as v(index, platform, category, type, marker_title, "
            "marker_group, fts_query, to_analyse) where to_analyse = 1)")


def _scoped(valid: list[tuple]) -> str:
    return f"""select mk.index as m, s.uid, s.spans,
        p.platform = mk.platform as in_all, p.platform = 'q_' || mk.platform as in_qanon,
        p.platform = mk.platform and p.uid in (select uid from sample) as in_sample
      from spans s join {_marker_rows(valid)} mk on mk.index = s.m join fx_posts p using (uid)
      where p.platform in (mk.platform, 'q_' || mk.platform)"""


SCOPES = ("all", "qanon", "sample")


def _report(rows: list[tuple], invalid: tuple[str, ...] = ()) -> str:
    valid = [r for r in rows if r[0] not in invalid]
    sums = ", ".join(
        f"count_if(in_{s}) as c_{s}, coalesce(sum(spans) filter (where in_{s}), 0) as s_{s}"
        for s in SCOPES)
    total = {
        "all": "(select count_posts from totals t where t.platform = mk.platform)",
        "qanon": "(select count_posts from totals t where t.platform = 'q_' || mk.platform)",
        "sample": "(select count(*) from sample t where t.platform = mk.platform)",
    }
    bad = "coalesce(mk.index in (" + ", ".join(
        f"'{i}'" for i in ("", *invalid) if i is not None) + "), true)"
    out = []
    for s in SCOPES:
        c, n = f"coalesce(c_{s}, 0)", f"coalesce(s_{s}, 0)"
        rel = f"coalesce(printf('%.10f', {c} / nullif(cast({total[s]} as double), 0)), '-1')"
        out += [
            f"cast(case when {bad} then -1 else {c} end as bigint) as count_{s}",
            f"case when {bad} then '-1' else {rel} end as count_{s}_rel",
            f"cast(case when {bad} then -1 else {n} end as bigint) as match_{s}",
            f"case when {bad} or {c} = 0 then -1.0 else cast({n} as double) / {c} end "
            f"as match_{s}_ratio",
        ]
    return (f"select mk.index, mk.platform, mk.category, mk.type, mk.marker_title, mk.marker_group, "
            f"mk.fts_query, mk.to_analyse, {', '.join(out)} from {_marker_rows(rows)} mk left join "
            f"(select m, {sums} from ({_scoped(valid)}) group by m) c on c.m = mk.index")


NEEDED = ("spans", "sample", "totals", "fx_posts")


def _with_report(body: str) -> str:
    return _with(body.format(report=_report(fx.MARKERS)), *NEEDED, markers=ALL_MARKERS)


def _sums() -> str:
    parts = [f"cast(coalesce(sum(count_{s}) filter (where count_{s} <> -1), 0) as bigint) as count_{s}"
             for s in SCOPES]
    parts += [f"printf('%.10f', coalesce(sum(cast(count_{s}_rel as double)) "
              f"filter (where count_{s}_rel <> '-1'), 0)) as count_{s}_rel" for s in SCOPES]
    parts += [f"cast(coalesce(sum(match_{s}) filter (where match_{s} <> -1), 0) as bigint) as match_{s}"
              for s in SCOPES]
    return ", ".join(parts)


def _marked(markers: dict[str, list[tuple]], columns: str, extra: str = "", where: str = "true") -> str:
    """Hit rows with the body put together from pieces and tags."""
    starts = "(select list(start) from islands i where i.m = s.m and i.uid = p.uid)"
    stops = "(select list(stop) from islands i where i.m = s.m and i.uid = p.uid)"
    body = f"""select s.m, s.spans, p.*, {starts} as starts, {stops} as stops,
          regexp_extract_all(body, '{WORD}') as words, regexp_split_to_array(body, '{WORD}') as seps
        from spans s join fx_posts p using (uid)"""
    text = f"""list_aggregate(list_transform(seps, lambda x, i: x ||
          case when i > len(words) then '' else
          case when list_contains(starts, i - 1) then '{OPEN_TAG}' else '' end || words[i] ||
          case when list_contains(stops, i - 1) then '{CLOSE_TAG}' else '' end end),
          'string_agg', '')"""
    return _with(
        f"select {columns.format(body=text + ' as body')} from ({body}) b {extra} where {where}",
        "spans", "islands", "fx_posts", "sample", "ranks", markers=markers)


def _hit_columns(table: str) -> str:
    return ", ".join(
        "{body}" if c == "body" else f"{table}.epoch" if c == "timestamp"
        else "r.rank" if c == "rank" else f"{table}.{c}" for c in MATCH_VIEW)


_RANKED = f"join ranks r on r.m = b.m and r.uid = b.uid join {_marker_rows(fx.MARKERS)} mk on mk.index = b.m"
_OWN = "b.platform in (mk.platform, 'q_' || mk.platform)"


def _found(name: str) -> str:
    return _with("""
        select m.uid, p.platform, h.hits, s.spans from matched m
        join (select uid, count(*) as hits from hits where kept group by uid) h using (uid)
        join spans s using (uid) join fx_posts p using (uid)""",
                 "matched", "spans", "fx_posts", markers={"m": reg.EXPRESSIONS[name]})


def _per_day(days: str) -> str:
    columns = ", ".join(f"cast(count_if({test}) as bigint) as count_{name}" for name, test in (
        ("alpha", "platform = 'alpha'"), ("q_alpha", "platform = 'q_alpha'"),
        ("sample_alpha", "platform = 'alpha' and sampled"),
        ("beta", "platform = 'beta'"), ("q_beta", "platform = 'q_beta'"),
        ("sample_beta", "platform = 'beta' and sampled")))
    return _with(f"""select date, {columns} from (
        select {_day('epoch')} as date, platform, uid in (select uid from sample) as sampled
        from fx_posts) group by date {days} order by date""", "sample", "fx_posts")


def _drawn(size: str, *needs: str) -> str:
    return _with(f"select k.uid, k.platform from keyed k join ({size}) s using (platform) "
                 "where place <= n", "keyed", "totals", *needs)


def _numbered(names: str) -> str:
    return f"select name, row_number() over (order by md5(name), name) as uid from ({names})"


def _seconds(column: str) -> str:
    return f"make_timestamp(({column}) // 1000 * 1000000)"


_ID = "1509134400000 + page_id * 60000"

ORACLES: dict[str, str] = {
    "ingest_q_board_csv": _with("""
        select 'q_alpha' as platform, '/pol/' as board, 'comment' as post_type, post_id, epoch,
          thread_id, post_id as parent_id, author, coalesce(subject, '') as subject,
          '>>' || post_id || chr(10) || body as body, cast(null as varchar) as extras
        from fx_posts""", "fx_posts"),
    "ingest_q_forum_csv": _with("""
        select 'q_beta' as platform, 'r/' || forum as board, 'comment' as post_type, post_id, epoch,
          cast(null as varchar) as thread_id, coalesce(parent_id, '') as parent_id,
          cast(null as varchar) as author, cast(null as varchar) as subject, body,
          cast(null as varchar) as extras
        from fx_threads""", "fx_threads"),
    "ingest_submissions": _with("""
        select 'beta' as platform, 'r/' || board as board, 'submission' as post_type, post_id, epoch,
          cast(null as varchar) as thread_id, cast(null as varchar) as parent_id, author,
          body as subject, cast(null as varchar) as body,
          thread_id as media, 'self' as thumbnail,
          'http://x/?a=1&b=' || post_id as url
        from fx_posts""", "fx_posts"),
    "ingest_comments": _with("""
        select 'beta' as platform, 'r/' || forum as board, 'comment' as post_type, post_id, epoch,
          thread_id, parent_id, author, cast(null as varchar) as subject, body,
          cast(null as varchar) as extras
        from fx_threads""", "fx_threads"),
    "ingest_board_dump": _with("""
        select 'alpha' as platform, '/' || board || '/' as board, 'comment' as post_type, post_id,
          epoch, thread_id, nullif(regexp_extract(body, '^>>([0-9]+)', 1), '') as parent_id, author,
          coalesce(subject, 'N') as subject, body,
          case when extras is not null then 'that_' || post_id || '.jpg' end as extras
        from fx_posts""", "fx_posts"),
    "ingest_dump_splits": _with("""
        select 'alpha' as platform, '/all/' as board, 'comment' as post_type, post_id,
          epoch, thread_id, nullif(regexp_extract(body, '^>>([0-9]+)', 1), '') as parent_id, author,
          coalesce(subject, 'N') as subject, body,
          case when extras is not null then 'that_' || post_id || '.jpg' end as extras
        from fx_posts""", "fx_posts"),
    "ingest_quarantine": _with("""
        select '/' || board || '/' as board, count(*) as accepted,
          cast(sum(len(string_split(body, chr(10)))) as bigint) as rejected
        from fx_posts group by 1""", "fx_posts"),
    "ingest_image_manifest": _with("""
        select 'alpha' as platform, '/' || board || '/' as board, group1,
          group1 * 1000000 as date_from, (group1 + 1) * 1000000 - 1 as date_to,
          'https://example.org/download/scope1/' || board || '-' || group1 || '.tar.gz' as url, size
        from fx_archives""", "fx_archives"),
    "thumb_catalog": f"""
        select 'alpha' as platform, '/b' || (page_id % 4) || '/' as board, {_ID} as image_id,
          ({_ID}) || 's.jpg' as thumb_name, octet_length(encode(html)) as thumb_size,
          md5(html) as data
        from pages""",
    "thumb_catalog_range": f"""
        select 'alpha' as platform, '/b' || (page_id % 4) || '/' as board, {_ID} as image_id,
          ({_ID}) || 's.jpg' as thumb_name, octet_length(encode(html)) as thumb_size
        from pages where ({_ID}) // 1000 between {_epoch(reg.THUMB_RANGE[0])}
          and {_epoch(reg.THUMB_RANGE[1])}""",
    "board_from_path": "select '/' || source || '/' as board, count(*) as n from documents group by 1",
    "source_selection": """
        select source, name, kind, source_rank from (
          select distinct case lang when 'en' then 'board' when 'fr' then 'research' else 'forum' end
              as source,
            case lang when 'en' then source || '.csv.gz' when 'de' then source || '_submissions.gz'
              else source || '_comments.gz' end as name,
            case lang when 'en' then 'board_dump' when 'de' then 'submissions' else 'comments' end
              as kind,
            case lang when 'en' then 3 else 2 end as source_rank from documents)
        where source <> 'research' and name not in ('src3.csv.gz', 'src4_submissions.gz')""",
    "dedupe_first_wins": _with(f"""
        select {KEY}, cast(c as integer) as source_rank, author || '-' || (4 - c) as author, body from (
          select *, row_number() over (partition by {KEY} order by c) as rn
          from fx_posts cross join range(1, 4) t(c)) where rn = 1""", "fx_posts"),
    "dedupe_stored": _with(f"""
        select {KEY}, case when platform = 'beta' then 1 else 2 end as source_rank,
          case when platform = 'beta' then 'first' else author end as author, body
        from fx_posts""", "fx_posts"),
    "incremental_append": _with(f"select {KEY}, author, body from fx_posts", "fx_posts"),
    "dedupe_images": _with("""
        select platform, board, image_id, thumb_name, thumb_size, source_rank from (
          select *, 1 as source_rank, row_number() over (partition by platform, board, image_id
            order by thumb_size, thumb_name) as rn from fx_images) where rn = 1""", "fx_images"),
    "dedupe_archives": _with(
        "select 'alpha' as platform, board, group1, size, 1 as source_rank from fx_archives",
        "fx_archives"),
    "build_board_dim": f"""
        with a as ({_numbered('select distinct source as name from documents')}),
        b as ({_numbered('select distinct event_type as name from events '
                         'where event_type not in (select source from documents)')})
        select uid, name from a union all
        select (select max(uid) from a) + uid, name from b""",
    "surrogate_key": _with(f"""
        select h * 128 + row_number() over (partition by h order by {KEY}) - 1 as uid,
          platform, board, post_type, post_id from (select *, cast('0x' || substr(md5(
            concat_ws(':', platform, board, post_type, post_id, epoch)), 1, 14) as bigint) as h
          from fx_posts)""", "fx_posts"),
    "surrogate_key_index": _with(f"""
        select h * 128 + row_number() over (partition by h order by {KEY}) - 1 as uid,
          platform, board, post_type, post_id from (select *, cast('0x' || substr(md5(
            concat_ws(':', platform, board, post_type, post_id, epoch)), 1, 14) as bigint) as h
          from fx_posts)""", "fx_posts"),
    "load_summary": _with("""
        select platform, board, count(*) as records,
          cast(coalesce(sum(length(body)), 0) as bigint) as body_chars,
          min(epoch) as first_epoch, max(epoch) as last_epoch
        from fx_posts group by 1, 2""", "fx_posts"),
    "date_range_posts": _with(f"""
        select uid, epoch from fx_posts
        where epoch between {_epoch(reg.RANGE[0])} and {_epoch(reg.RANGE[1])}""", "fx_posts"),
    "date_range_images": _with(f"""
        select board, image_id, thumb_name from fx_images where image_id // 1000
          between {_epoch(reg.IMAGE_RANGE[0])} and {_epoch(reg.IMAGE_RANGE[1])}""", "fx_images"),
    "parent_from_quote": _with("""
        select uid, form, nullif(regexp_extract(b, '^>>([0-9]+)', 1), '') as parent_id from (
          select uid, cast(0 as bigint) as form, '>>' || uid || chr(10) || body as b from fx_posts union all
          select uid, 1, body || chr(10) || '>>' || uid from fx_posts union all
          select uid, 2, body from fx_posts)""", "fx_posts"),
    "null_marker": _with("select uid, subject from fx_posts", "fx_posts"),
    "param_select": _with(
        "select 'beta' as test, count(*) as count_posts from fx_posts where platform = 'beta'",
        "fx_posts"),
    "view_posts_full": _with(f"select {_names(FULL_VIEW)} from fx_posts", "fx_posts"),
    "view_posts_meta": _with(f"select {_names(META_VIEW)} from fx_posts", "fx_posts"),
    "view_platform": _with(
        f"select {_names(FULL_VIEW)} from fx_posts where platform = 'q_alpha'", "fx_posts"),
    "view_platform_meta": _with(
        f"select {_names(META_VIEW)} from fx_posts where platform = 'beta'", "fx_posts"),
    "view_images_meta": _with(f"""
        select i.uid, cast(1 as bigint) as platform_uid, d.uid as board_uid, image_id, thumb_name, thumb_size,
          platform, board from fx_images i join
          ({_numbered('select distinct board as name from fx_images')}) d on d.name = i.board""",
                              "fx_images"),
    "view_images_full": _with("""
        select c.platform, c.board, c.image_id, md5(b.data) as thumb_md5,
          case when b.board = 'b1' then octet_length(b.data) end as image_bytes
        from (select platform, board, image_id from fx_blobs union all
              select platform, board, image_id from fx_images) c
        left join fx_blobs b using (platform, board, image_id)""", "fx_blobs", "fx_images"),
    "image_archives_gb": _with(
        "select *, size // 1024 // 1024 // 1024 as size_gb from fx_archives", "fx_archives"),
    "counts_per_board": _with("""
        select board, platform, count(*) as count_posts from fx_posts group by 1, 2
        order by 3 desc, 1, 2""", "fx_posts"),
    "counts_per_board_merged": _with("""
        select board, platform, cast(sum(n) as bigint) as count_posts
        from (select board, platform, uid % 2, count(*) as n from fx_posts group by 1, 2, 3)
        group by 1, 2""", "fx_posts"),
    "posts_per_day_merged": _per_day(""),
    "counts_per_platform": _with("select * from totals", "totals"),
    "image_count_board": _with(
        "select count(image_id) as count_images from fx_images where board = 'click'", "fx_images"),
    "image_time_span": _with(f"""
        select strftime({_seconds('min(image_id)')}, '%Y-%m-%d %H:%M:%S') as first,
          strftime({_seconds('max(image_id)')}, '%Y-%m-%d %H:%M:%S') as last
        from fx_images where board = 'click'""", "fx_images"),
    "images_per_day": _with(f"""
        select strftime({_seconds('image_id')}, '%Y-%m-%d') as date, count(image_id) as count_per_day
        from fx_images where board = 'click' group by 1 order by 1""", "fx_images"),
    "sample_matched": _drawn("""
        select t.platform, q.count_posts as n from totals t
        join totals q on q.platform = 'q_' || t.platform"""),
    "sample_ratio": _drawn(f"""
        select platform, count_posts // 100 * (case platform
          {' '.join(f"when '{p}' then {n}" for p, n in reg.RATIO.items())} end) as n from totals"""),
    "sample_one_percent": _drawn("select platform, count_posts // 100 as n from totals"),
    "sample_weighted": _drawn("select platform, sample_size as n from weighted", "weighted"),
    "sample_sizes": _with(
        "select platform, count(*) as sample_size from sample group by 1", "sample"),
    "counts_with_samples": _with("""
        select * from totals union all
        select 'sample_' || platform, count(*) from sample group by 1""", "totals", "sample"),
    "sample_dump_full": _with(
        f"select {_names(FULL_VIEW)} from fx_posts where uid in (select uid from sample)",
        "fx_posts", "sample"),
    "head_tail_fixture": """
        with r as (select source, doc_id, text,
          row_number() over (partition by source order by doc_id) as up,
          row_number() over (partition by source order by doc_id desc) as down from documents)
        select source, doc_id, text from r where up <= 10 union all
        select source, doc_id, text from r where down <= 10""",
    "posts_per_day": _per_day(""),
    "posts_per_day_spine": _per_day("having count_if(platform = 'alpha') > 0"),
    "token_counts": _with("""
        select uid, len(tokens) as n_tokens, len(list_distinct(tokens)) as n_distinct, dl from toks""",
                          "toks"),
    **{name: _found(name) for name in reg.EXPRESSIONS},
    "match_ranked": _with(
        "select uid, platform, rank from ranks join fx_posts using (uid) order by rank, uid",
        "ranks", "fx_posts",
        markers={"m": [(False, [("term", ["that"], None), ("prefix", ["tion"], None)])]}),
    "match_highlight": _marked(
        {"m": [(False, [("prefix", ["ee"], None), ("phrase", ["of", "the"], None)])]},
        "b.uid, b.spans, {body}"),
    "match_rows": _marked(
        {"m": [(False, [("term", ["que"], None)])]},
        _hit_columns("b") + ", b.platform = 'alpha' as in_all, b.platform = 'q_alpha' as in_qanon, "
        "b.platform = 'alpha' and b.uid in (select uid from sample) as in_sample",
        "join ranks r on r.uid = b.uid", "b.platform in ('alpha', 'q_alpha')"),
    "marker_report": _with(_report(fx.MARKERS), *NEEDED, markers=ALL_MARKERS),
    "marker_report_parts": _with(_report(fx.MARKERS), *NEEDED, markers=ALL_MARKERS),
    "marker_invalid": _with(
        _report(fx.BROKEN_MARKERS + fx.MARKERS[:1], tuple(r[0] for r in fx.BROKEN_MARKERS)),
        *NEEDED, markers={"m01": ALL_MARKERS["m01"]}),
    "marker_hits": _with(f"""
        with u as (select m, uid, unnest(list_filter([case when in_all then 'all' end,
            case when in_qanon then 'qanon' end, case when in_sample then 'sample' end],
            lambda x: x is not null)) as scope from ({_scoped(fx.MARKERS)})),
        n as (select m, scope, cast(ceil(count(*) / {reg.LIST_LENGTH}.0) as bigint) as parts
          from u group by 1, 2)
        select m as index, scope,
          cast('0x' || substr(md5(cast(uid as varchar)), 1, 8) as bigint) % parts as part,
          string_agg(cast(uid as varchar), ',' order by uid) as uids
        from u join n using (m, scope) group by 1, 2, 3""".replace("with u as", ", u as", 1),
                         *NEEDED, markers=ALL_MARKERS),
    "marker_hit_rows": _marked(ALL_MARKERS, "b.m as index, " + _hit_columns("b"), _RANKED, _OWN),
    "drilldown": _marked(
        ALL_MARKERS,
        "b.post_id, b.epoch, b.author, b.platform, b.board, r.rank, {body}", _RANKED,
        _OWN + " and b.m = 'm10' and b.platform = mk.platform and b.uid in (select uid from sample)"),
    "rollup_category": _with_report(
        "select platform, category, arg_min(type, index) as type, " + _sums()
        + " from ({report}) group by 1, 2"),
    "rollup_group": _with_report(
        "select platform, marker_group, arg_min(category, index) as category, "
        "arg_min(type, index) as type, " + _sums() + " from ({report}) group by 1, 2"),
    **{f"rollup_{short}_once": _with(
        f"select mk.platform, mk.{level}, "
        + ", ".join(f"count(distinct uid) filter (where in_{s}) as count_{s}" for s in SCOPES)
        + f" from {_marker_rows(fx.MARKERS)} mk left join ({_scoped(fx.MARKERS)}) h on mk.index = h.m "
        "group by 1, 2", *NEEDED, markers=ALL_MARKERS)
       for short, level in (("category", "category"), ("group", "marker_group"))},
    "heat_scale": _with_report("""
        , r as ({report}), v as (
          select index, measure, 'rel' as kind, cast(value as double) as value from
            (unpivot (select index, count_all_rel, count_qanon_rel, count_sample_rel from r)
             on count_all_rel, count_qanon_rel, count_sample_rel into name measure value value)
          union all select index, measure, 'ratio', value from
            (unpivot (select index, match_all_ratio, match_qanon_ratio, match_sample_ratio from r)
             on match_all_ratio, match_qanon_ratio, match_sample_ratio into name measure value value)),
        k as (select * from v where value <> -1)
        select index, measure, kind, value,
          sqrt((value - min(value) over (partition by kind))
            / nullif(max(value) over (partition by kind) - min(value) over (partition by kind), 0))
            as scaled from k"""),
}
