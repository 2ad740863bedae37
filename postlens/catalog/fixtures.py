"""Relations of the post archive, derived from the given tables.

Each relation is one SQL text that both engines read; ``{S}`` is the string type, and the few
functions that differ by name are filled in per engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import pin_utc
from postlens.sources.layout import spread_small
from postlens.sources.markers import all_of, any_of, atom, marker_table, none_of

SEED = 7
PLATFORMS = ("alpha", "beta")
SPARK = {"S": "string", "BLOB": "cast(html as binary)", "MS": "unix_millis(cast(ts as timestamp))"}
DUCK = {"S": "varchar", "BLOB": "encode(html)", "MS": "(epoch_us(ts) // 1000)"}

# ``body`` is the whole text; subjects and extras are filled in for some posts so that their
# tokens count for the length but never as a hit.
POSTS = """
select doc_id as uid, cast(doc_id as {S}) as post_id,
  case lang when 'en' then 'alpha' when 'fr' then 'q_alpha'
            when 'de' then 'beta' else 'q_beta' end as platform,
  source as board,
  case when doc_id % 10 = 0 then 'submission' else 'comment' end as post_type,
  1509134400 + (doc_id * 7919 % 370) * 86400 + doc_id % 86400 as epoch,
  cast(n_chars as {S}) as thread_id,
  cast(null as {S}) as parent_id,
  cast(null as bigint) as thread_uid, cast(null as bigint) as parent_uid,
  concat('user', cast(doc_id % 97 as {S})) as author,
  case when doc_id % 5 = 0 then concat('That license ', source) end as subject,
  text as body,
  case when doc_id % 7 = 0 then concat('{{"thumbnail":"that_', cast(doc_id as {S}), '.jpg"}}') end
    as extras
from documents"""

THREADS = """
select conv_id * 1000 + turn as uid, cast(conv_id * 1000 + turn as {S}) as post_id,
  cast(conv_id as {S}) as thread_id,
  case when turn = 0 then null else cast(conv_id * 1000 + turn - 1 as {S}) end as parent_id,
  1509134400 + conv_id * 3600 + turn * 60 as epoch,
  case when conv_id % 13 = 5 then 'subreddit' else concat('sub', cast(conv_id % 13 as {S})) end as forum,
  role as author, text as body
from conversations"""

IMAGES = """
select event_id as uid, 'alpha' as platform, event_type as board, {MS} as image_id,
  concat(cast({MS} as {S}), 's.jpg') as thumb_name, event_id % 5000 as thumb_size
from events"""

BLOBS = """
select 'alpha' as platform, concat('b', cast(page_id % 4 as {S})) as board,
  1509134400000 + page_id * 60000 as image_id, {BLOB} as data
from pages"""

ARCHIVES = """
select event_type as board, {MS} // 1000000000 as group1, count(*) * 123456789 as size
from events group by 1, 2"""

# SQL text of each relation and the table it reads.
RELATIONS = {
    "fx_posts": (POSTS, "documents"),
    "fx_threads": (THREADS, "conversations"),
    "fx_images": (IMAGES, "events"),
    "fx_blobs": (BLOBS, "pages"),
    "fx_archives": (ARCHIVES, "events"),
}


def duck_sql(name: str) -> str:
    return RELATIONS[name][0].format(**DUCK)


def _sql(name: str) -> str:
    # Braces in the text stand for themselves, only the table becomes a parameter.
    table = RELATIONS[name][1]
    text = RELATIONS[name][0].format(**SPARK).replace("//", "div")
    return text.replace("{", "{{").replace("}", "}}").replace(f"from {table}", "from {source}")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame over the whole table."""
    pin_utc(spark)
    table = RELATIONS[name][1]
    path = f"{sf_dir}/{table}.parquet"
    source = spread_small(spark.read.parquet(path), path)
    return spark.sql(_sql(name), source=source)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "fx_posts").withColumn(
        "timestamp", F.timestamp_seconds("epoch"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(index: str | None, platform: str | None, category: str, group: str, text: str, clauses: list,
         to_analyse: int = 1) -> tuple:
    kind = "word" if " " not in text else "expression"
    return index, platform, category, kind, f"title {index}", group, text, to_analyse, clauses


MARKERS = [
    _row("m01", "alpha", "c1", "g1", "that", all_of(any_of(atom("term", "that")))),
    _row("m02", "alpha", "c1", "g1", "tion*", all_of(any_of(atom("prefix", "tion")))),
    _row("m03", "beta", "c1", "g2", "und", all_of(any_of(atom("term", "und")))),
    _row("m04", "beta", "c2", "g2", "der*", all_of(any_of(atom("prefix", "der")))),
    _row("m05", "alpha", "c2", "g3", '"of the"', all_of(any_of(atom("phrase", "of", "the")))),
    _row("m06", "alpha", "c2", "g3", "que", all_of(any_of(atom("term", "Que")))),
    _row("m07", "alpha", "c2", "g3", "license*", all_of(any_of(atom("prefix", "license")))),
    _row("m08", "alpha", "c3", "g4", "the", all_of(any_of(atom("term", "the")))),
    _row("m09", "beta", "c3", "g4", "zzzzqq", all_of(any_of(atom("term", "zzzzqq")))),
    _row("m10", "alpha", "c3", "g4", "that NOT que",
         all_of(any_of(atom("term", "that")), none_of(atom("term", "que")))),
    _row("m11", "alpha", "c3", "g5", "off", all_of(any_of(atom("term", "off"))), to_analyse=0),
]

BROKEN_MARKERS = [
    _row("x1", "alpha", "c1", "g1", "no clause", []),
    _row("x2", "alpha", "c1", "g1", "NOT that", all_of(none_of(atom("term", "that")))),
    _row("x3", "alpha", "c1", "g1", "bad kind", all_of(any_of(atom("fuzzy", "that")))),
    _row("x4", "alpha", "c1", "g1", "...", all_of(any_of(atom("term", "...")))),
    _row("x5", "alpha", "c1", "g1", "NEAR(a)", all_of(any_of(atom("near", "that")))),
    _row("x6", "alpha", "c1", "g1", "that", all_of(any_of(atom("term", "that")))),
    _row("x6", "alpha", "c1", "g1", "que", all_of(any_of(atom("term", "que")))),
    _row(None, "alpha", "c1", "g1", "that", all_of(any_of(atom("term", "that")))),
]


def markers(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return marker_table(spark, MARKERS if rows is None else rows)


def one_marker(spark: SparkSession, *clauses: tuple) -> DataFrame:
    return marker_table(spark, [_row("m", "alpha", "c", "g", "m", all_of(*clauses))])


Query = Callable[[SparkSession, str], DataFrame]
