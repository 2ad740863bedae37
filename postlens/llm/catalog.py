"""The queries of this subpackage: name -> (spark, folder) -> DataFrame, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import (
    decontamination, html_crf, jaccard, kneser_ney, language, lexical, line_dedup, merkle, packing, pii,
    quality_rules, sharding, topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 24)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.redactions(docs).select(
        "doc_id",
        *[pii.counted(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(
        table(spark, sf_dir, "documents"), F.col("lang"), [F.col("source")]).drop("body")


@query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


@query
def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of op8 that only pages have: markup language, address suffix, host and domain."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), host.alias("host"),
        F.regexp_extract("html", r"(?i)<html[^>]*\blang=\"?([a-zA-Z]+)", 1).alias("markup"),
        F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"))
    found = language.identify(
        pages, F.nullif(F.lower("markup"), F.lit("")),
        [F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.nullif("host", F.lit(""))],
        F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))
    return found.withColumnRenamed("doc_id", "page_id").drop("body")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (
  select key, max(doc_id) as top from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
marked as (
  select k.doc_id, k.line, k.pos, s.top is not null and k.doc_id <> s.top as gone
  from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op11_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLES["op11_columnar_topk"] = """
with scaled as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from scaled q join scaled c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
ranked as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank,
    vec_id, score from scored)
select * from ranked where rank <= 10
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_text()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op12_merkle_manifest"] = """
with recursive base as (
  select *, list_reduce(
      flatten([[4294967295]::bigint[]] || list_transform(string_split(doc_id::varchar, ''),
        lambda ch: [ascii(ch)::bigint, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: case when xor(c, b) & 1 = 1 then xor(xor(c, b) >> 1, 3988292384) else xor(c, b) >> 1 end) as crc
  from documents),
texts as (
  select *, case when xor(crc, 4294967295) % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') else text end as other_text from base),
encoded as (
  select doc_id, coalesce('=' || lang, '') as grp, text, other_text,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-')
    || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head
  from texts),
hashed as (
  select doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(other_text) || ':' || other_text, '-')) as other
  from encoded),
leaves as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by grp) as n from hashed),
nodes as (
  select 0 as lvl, grp, pos, leaf as digest, n from leaves
  union all
  select lvl + 1, grp, pos // 8, sha256(string_agg(digest, '' order by pos)), max((n + 7) // 8)
  from nodes where n > 1 group by lvl, grp, pos // 8),
subroots as (select grp, digest, row_number() over (order by grp) - 1 as place, count(*) over () as m from nodes where n = 1),
tops as (
  select 0 as lvl, place as pos, digest, m as n from subroots
  union all
  select lvl + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), max((n + 7) // 8)
  from tops where n > 1 group by lvl, pos // 8),
runs as (
  select lvl, grp, pos, string_agg(digest, '') over (partition by lvl, grp, pos // 8 order by pos
      rows between unbounded preceding and 1 preceding) as lefts,
    string_agg(digest, '') over (partition by lvl, grp, pos // 8 order by pos
      rows between 1 following and unbounded following) as rights
  from nodes where n > 1),
top_runs as (
  select lvl, pos, string_agg(digest, '') over (partition by lvl, pos // 8 order by pos
      rows between unbounded preceding and 1 preceding) as lefts,
    string_agg(digest, '') over (partition by lvl, pos // 8 order by pos
      rows between 1 following and unbounded following) as rights
  from tops where n > 1),
lower_steps as (
  select l.grp, l.pos, list(coalesce(r.lefts, '') || '|' || coalesce(r.rights, '') order by r.lvl) as steps
  from leaves l join runs r on r.grp = l.grp and r.pos = l.pos // (8 ** r.lvl)::bigint group by all),
upper_steps as (
  select s.grp, list(coalesce(r.lefts, '') || '|' || coalesce(r.rights, '') order by r.lvl) as steps
  from subroots s join top_runs r on r.pos = s.place // (8 ** r.lvl)::bigint group by all),
walked as (
  select l.doc_id, l.leaf, l.other, s.digest as subroot, (select digest from tops where n = 1) as root,
    coalesce(a.steps, []::varchar[]) || coalesce(b.steps, []::varchar[]) as steps
  from leaves l join subroots s on s.grp = l.grp
  left join lower_steps a on a.grp = l.grp and a.pos = l.pos
  left join upper_steps b on b.grp = l.grp),
folded as (
  select *, list_reduce([other] || steps, lambda acc, x: sha256(replace(x, '|', acc))) as folded_root from walked)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256,
  folded_root, folded_root = root as verified
from folded
"""


@query
def op13_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_norm_bucket_search"] = r"""
with doc_terms as (
  select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
item_terms as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
sizes as (select r, doc_id, count(*) as n from doc_terms group by all),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as len from sizes),
tfs as (
  select r, doc_id, term, count(*) as tf from doc_terms
  where term in (select term from item_terms) group by all),
weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w
  from tfs, corpus group by term, docs),
impacts as (
  select t.r, t.doc_id, t.term,
    w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // len)))) as x
  from tfs t join sizes s on t.r = s.r join weighed e on e.term = t.term, corpus),
scores as (
  select item_id, r, doc_id, sum(x)::bigint as score from item_terms join impacts using (term) group by all),
ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from scores where score > 0)
select * from ranked where rank <= 20
"""
