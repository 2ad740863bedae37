"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.catalog import fixtures as fx
from postlens.functions import fields
from postlens.operators import (
    counts, dedupe, dimensions, matching, ranking, report, rollups, sampling, statistics, views,
)
from postlens.operators.uid_index import UidIndex, by_key, known_keys
from postlens.schema import ARCHIVE_KEY, CLOSE_TAG, FULL_VIEW, IMAGE_KEY, OPEN_TAG, POST_KEY
from postlens.sinks import tables
from postlens.sources import images, posts as sources, selection
from postlens.sources.layout import checkpoint_folder, settled, stored
from postlens.sources.markers import SMALL_MARKERS, any_of, atom, none_of, prepare

SEED = fx.SEED
SAMPLE_TOTAL = 300
RATIO = {"alpha": 10, "beta": 50}
LIST_LENGTH = 100
RANGE = ("2017-11-27T20:00:00", "2018-08-02T03:59:59")
IMAGE_RANGE = ("2024-01-03T06:00:00", "2024-01-20T03:59:59")
THUMB_RANGE = ("2017-10-27T20:10:00", "2017-10-27T20:40:00")

QUERIES: dict[str, fx.Query] = {}


def query(fn: fx.Query) -> fx.Query:
    QUERIES[fn.__name__] = fn
    return fn


def epoch() -> Column:
    return F.unix_seconds("timestamp").alias("epoch")


def plain(posts: DataFrame) -> DataFrame:
    """Times as epoch seconds, the form the checks compare."""
    return posts.select(*[epoch() if c == "timestamp" else c for c in posts.columns])


# --- sources -------------------------------------------------------------------------


def _ingested(shaped: DataFrame) -> DataFrame:
    return plain(sources.accepted(shaped).drop("source_file"))


def _csv_lines(rows: DataFrame, *columns: Column) -> DataFrame:
    keep_space = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.to_csv(F.struct(*columns), {"quoteAll": "true", "escape": '"', **keep_space})
    return rows.select(line.alias("line"))


def _from_csv(lines: DataFrame, schema: str, options: dict) -> DataFrame:
    others = [c for c in lines.columns if c != "line"]
    # Unpacked by a generator: a filter on the fields then cannot repeat the parsing.
    return lines.select(F.inline(F.array(F.from_csv("line", schema, options))), *others)


@query
def ingest_q_board_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit(">>"), "uid", F.lit("\n"), "body").alias("body")
    lines = _csv_lines(
        fx.posts(spark, sf_dir), F.col("thread_id"), F.col("post_id"), F.col("author"),
        F.col("subject"), body, F.col("epoch"))
    raw = _from_csv(lines, sources.RESEARCH_BOARD_RAW, sources.QUOTED_CSV)
    return _ingested(sources.research_board_posts(raw, "q_alpha"))


@query
def ingest_q_forum_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _csv_lines(
        fx.relation(spark, sf_dir, "fx_threads"), F.col("post_id"), F.col("parent_id"),
        F.col("forum"), F.col("body"), F.col("epoch"))
    raw = _from_csv(lines, sources.RESEARCH_FORUM_RAW, sources.QUOTED_CSV)
    return _ingested(sources.research_forum_posts(raw, "q_beta"))


def _from_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.inline(F.array(F.from_json("line", schema, sources.JSON_LINES))))


@query
def ingest_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(
        F.col("board").alias("subreddit"), F.col("post_id").alias("id"),
        F.concat("epoch", F.when(F.col("uid") % 2 == 0, ".0").otherwise("")).alias("created_utc"),
        "author", F.col("body").alias("title"),
        F.struct(F.col("thread_id").alias("type")).alias("media"),
        F.lit("self").alias("thumbnail"),
        F.concat(F.lit("http://x/?a=1&b="), "uid").alias("url"))
    lines = fx.posts(spark, sf_dir).select(F.to_json(record).alias("line"))
    shaped = sources.submission_posts(_from_json(lines, sources.SUBMISSION_RAW), "beta")
    extras = F.from_json("extras", "media struct<type string>, thumbnail string, url string")
    return (
        _ingested(shaped).withColumn("extras", extras)
        .select("*", F.col("extras.media.type").alias("media"), "extras.thumbnail", "extras.url")
        .drop("extras")
    )


@query
def ingest_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(
        F.col("forum").alias("subreddit"), F.col("post_id").alias("id"),
        F.col("epoch").cast("double").alias("created_utc"), F.col("thread_id").alias("link_id"), "parent_id",
        "author", "body")
    lines = fx.relation(spark, sf_dir, "fx_threads").select(F.to_json(record).alias("line"))
    return _ingested(sources.comment_posts(_from_json(lines, sources.COMMENT_RAW), "beta"))


def _dump_lines(posts: DataFrame) -> DataFrame:
    """Dump records: 23 quoted fields, quotes and line breaks protected by a backslash."""
    values = {0: "post_id", 2: "thread_id", 4: "epoch", 14: "extras", 19: "author", 21: "subject",
              22: "body"}

    def field(no: int) -> Column:
        if no not in values:
            return F.lit('"N"')
        text = F.coalesce(F.col(values[no]).cast("string"), F.lit("N"))
        text = F.replace(text, F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), F.replace(text, F.lit("\n"), F.lit("\\\n")), F.lit('"'))

    return posts.select(
        F.concat_ws(",", *[field(i) for i in range(23)]).alias("line"),
        F.concat(F.lit("/data/"), "board", F.lit("_00.csv.gz")).alias("source_file"))


def _dump_posts(lines: DataFrame) -> DataFrame:
    raw = _from_csv(lines, sources.BOARD_DUMP_RAW, sources.ESCAPED_CSV)
    return sources.board_dump_posts(raw, "alpha")


@query
def ingest_board_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _ingested(_dump_posts(_dump_lines(fx.posts(spark, sf_dir))))
    inner = F.get_json_object("extras", "$.thumbnail")
    return done.withColumn("extras", F.get_json_object(inner, "$.thumbnail"))


@query
def ingest_dump_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records from plain files whose splits start anywhere in them."""
    folder = f"{checkpoint_folder(spark)}/dump-{uuid.uuid4().hex}/all_00.csv"
    _dump_lines(fx.posts(spark, sf_dir)).select("line").write.text(folder)
    done = _ingested(sources.accepted(sources.board_dump_posts(
        sources.read_csv(spark, folder, sources.BOARD_DUMP_RAW, sources.ESCAPED_CSV), "alpha")))
    inner = F.get_json_object("extras", "$.thumbnail")
    return done.withColumn("extras", F.get_json_object(inner, "$.thumbnail"))


@query
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records next to the torn-off lines of every body: only the records survive."""
    posts = fx.posts(spark, sf_dir)
    records = _dump_lines(posts)
    torn = posts.select(
        F.explode(F.split("body", "\n")).alias("line"),
        F.concat(F.lit("/data/"), "board", F.lit(".csv")).alias("source_file"))
    shaped = _dump_posts(records.unionByName(torn))
    return shaped.groupBy("board").agg(
        F.count_if(F.size("defects") == 0).alias("accepted"),
        F.count_if(F.size("defects") > 0).alias("rejected"))


@query
def ingest_image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit('<file name="'), "board", F.lit("-"), "group1", F.col("suffix"),
                     F.lit('"><size>'), "size", F.lit("</size></file>"))
    suffixes = F.explode(F.array(F.lit(".tar.gz"), F.lit(".zip"))).alias("suffix")
    texts = fx.relation(spark, sf_dir, "fx_archives").select("*", suffixes).select(
        entry.alias("text"))
    entries = texts.select(F.from_xml("text", images.MANIFEST_ENTRY).alias("r")).select(
        "r.*", F.lit("scope1").alias("scope"))
    return images.archive_entries(entries, "https://example.org/download/", "alpha")


def _thumb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = fx.relation(spark, sf_dir, "fx_blobs")
    good = F.concat(F.lit("t/1/2/"), "image_id", F.lit("s.jpg"))
    members = F.explode(F.array(good, F.lit("t/1/index"), F.lit("t/1/2/cover.jpg")))
    return blobs.select(
        F.concat("board", F.lit("_thumbs")).alias("archive"), members.alias("member"),
        F.octet_length("data").cast("bigint").alias("length"), F.col("data").alias("content"))


@query
def thumb_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.thumbnails(_thumb_files(spark, sf_dir), "alpha")
    return found.withColumn("data", F.md5("data"))


@query
def thumb_catalog_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.thumbnails(_thumb_files(spark, sf_dir), "alpha", *THUMB_RANGE)
    return images.image_rows(found)


@query
def board_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("lang") == "en", "_00.csv.gz").when(F.col("lang") == "fr", ".csv.gz")
    path = F.concat(F.lit("/dump/"), "source", F.coalesce(name, F.lit("_12.csv")))
    return (
        fx.table(spark, sf_dir, "documents").select(fields.board_from_path(path).alias("board"))
        .groupBy("board").agg(F.count("*").alias("n"))
    )


@query
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("lang") == "en", "board").when(F.col("lang") == "fr", "research")
    name = (
        F.when(F.col("lang") == "en", F.concat("source", F.lit(".csv.gz")))
        .when(F.col("lang") == "de", F.concat("source", F.lit("_submissions.gz")))
        .otherwise(F.concat("source", F.lit("_comments.gz"))))
    files = fx.table(spark, sf_dir, "documents").select(
        F.coalesce(source, F.lit("forum")).alias("source"),
        F.concat(F.lit("/in/"), name).alias("path")).distinct()
    chosen = selection.select_files(files, ["research"], ["src3.csv.gz", "src4_submissions.gz"])
    return chosen.select("source", "name", "kind", "source_rank")


def _copies(rows: DataFrame, n: int = 3) -> DataFrame:
    copy = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("source_rank")
    return rows.select("*", copy)


@query
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = _copies(fx.posts(spark, sf_dir)).withColumn(
        "author", F.concat("author", F.lit("-"), F.lit(4) - F.col("source_rank")))
    rows = copies.select(*POST_KEY, "source_rank", "author", "body")
    return plain(dedupe.first_wins(rows, POST_KEY, ["source_rank"]))


@query
def dedupe_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same choice where copies are rare: one platform is there three times."""
    rows = fx.posts(spark, sf_dir).withColumn("source_rank", F.lit(2))
    again = rows.where(F.col("platform") == "beta").select("*")
    earlier = again.withColumn("source_rank", F.lit(1)).withColumn("author", F.lit("first"))
    columns = [*POST_KEY, "source_rank", "author", "body"]
    all_rows = rows.unionByName(earlier).unionByName(again).select(*columns)
    return plain(dedupe.first_wins_stored(all_rows, POST_KEY, ["source_rank"]))


@query
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two platforms are stored; a batch with everything, twice, adds only the others."""
    rows = fx.posts(spark, sf_dir).select(*POST_KEY, "author", "body")
    stored = rows.where(F.col("platform").isin("alpha", "q_alpha"))
    batch = _copies(rows, 2).drop("source_rank")
    return plain(dedupe.append_new(stored, batch, POST_KEY))


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.relation(spark, sf_dir, "fx_images")


@query
def dedupe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _copies(_image_rows(spark, sf_dir), 2).drop("uid")
    return dedupe.first_wins(rows, IMAGE_KEY, ["source_rank", "thumb_size"])


@query
def dedupe_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.relation(spark, sf_dir, "fx_archives").withColumn("platform", F.lit("alpha"))
    return dedupe.first_wins(_copies(rows, 2), ARCHIVE_KEY, ["source_rank"])


@query
def build_board_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "uid long, name string")
    boards = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    kinds = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    first = dimensions.extend_dimension(none, boards)
    return dimensions.extend_dimension(first, boards.unionByName(kinds))


@query
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.posts(spark, sf_dir).select(*POST_KEY)
    return dedupe.with_uid(rows).select("uid", "platform", "board", "post_type", "post_id")


@query
def surrogate_key_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over two loads: the second, with everything, asks the index and adds what is new."""
    rows = fx.posts(spark, sf_dir).select(*POST_KEY)
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    index = UidIndex(spark, folder, 4)
    first = stored(dedupe.with_uid(rows.where(F.col("platform").isin("alpha", "q_beta"))))
    index.add(first.select("uid"))
    keys = settled(dedupe.key_hashes(rows))
    used = index.used(keys)
    known = known_keys(
        keys, used, first.withColumn("month", F.date_format("timestamp", "yyyy-MM")), POST_KEY)
    new = settled(by_key(keys, known, POST_KEY, "left_anti"))
    second = dedupe.with_slots(new.drop("hash"), dedupe.shared_slots(new, used=used))
    return first.unionByName(second).select("uid", "platform", "board", "post_type", "post_id")


@query
def marker_report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as for a marker table that is too large to list its tokens."""
    return _report(spark, sf_dir, limit=0)


@query
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.load_summary(fx.posts(spark, sf_dir))


# --- filters -------------------------------------------------------------------------


@query
def date_range_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sources.in_range(fx.posts(spark, sf_dir), *RANGE)
    return kept.select("uid", "epoch")


@query
def date_range_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _image_rows(spark, sf_dir).where(images.images_within(*IMAGE_RANGE))
    return kept.select("board", "image_id", "thumb_name")


@query
def parent_from_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of every body: quote in front, quote in the second line, no quote."""
    quote = F.concat(F.lit(">>"), "uid")
    bodies = F.posexplode(F.array(
        F.concat(quote, F.lit("\n"), "body"), F.concat("body", F.lit("\n"), quote), F.col("body")))
    rows = fx.posts(spark, sf_dir).select("uid", bodies.alias("form", "body"))
    return rows.select("uid", F.col("form").cast("bigint").alias("form"),
                       fields.parent_from_quote(F.col("body")).alias("parent_id"))


@query
def null_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("subject"), F.lit("N"))
    return fx.posts(spark, sf_dir).select("uid", fields.null_marker(raw).alias("subject"))


@query
def param_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "select :platform as test, count(*) as count_posts from {posts} where platform = :platform",
        args={"platform": "beta"}, posts=fx.posts(spark, sf_dir))


# --- views ---------------------------------------------------------------------------


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts stored by ids, joined back to their names."""
    posts = fx.posts(spark, sf_dir)
    none = spark.createDataFrame([], "uid long, name string")

    def dimension(column: str) -> DataFrame:
        return dimensions.extend_dimension(none, posts.select(F.col(column).alias("name")))

    boards, platforms, types = (settled(dimension(c)) for c in ("board", "platform", "post_type"))
    facts = dimensions.with_ids(posts, boards, platforms, types)
    return views.with_names(facts, boards, platforms, types)


@query
def view_posts_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(views.full_view(_star(spark, sf_dir)))


@query
def view_posts_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(views.meta_view(_star(spark, sf_dir)))


@query
def view_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(views.of_platform(views.full_view(fx.posts(spark, sf_dir)), "q_alpha"))


@query
def view_platform_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(views.of_platform(views.meta_view(fx.posts(spark, sf_dir)), "beta"))


def _named_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _image_rows(spark, sf_dir)
    none = spark.createDataFrame([], "uid long, name string")
    boards, platforms = (
        settled(dimensions.extend_dimension(none, rows.select(F.col(c).alias("name"))))
        for c in ("board", "platform"))
    by_id = (
        rows.join(boards.select(F.col("uid").alias("board_uid"), F.col("name").alias("board")), "board")
        .join(platforms.select(
            F.col("uid").alias("platform_uid"), F.col("name").alias("platform")), "platform")
        .drop("board", "platform"))
    return views.with_names(by_id, boards, platforms)


@query
def view_images_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_images(spark, sf_dir).select(
        "uid", "platform_uid", "board_uid", "image_id", "thumb_name", "thumb_size", "platform",
        "board")


@query
def view_images_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the thumbnails and of other images; only the former have data."""
    blobs = fx.relation(spark, sf_dir, "fx_blobs")
    catalogue = blobs.select(*IMAGE_KEY).unionByName(_image_rows(spark, sf_dir).select(*IMAGE_KEY))
    none = blobs.where(F.col("board") == "b1")
    full = views.images_with_data(catalogue, blobs, none)
    return full.select(*IMAGE_KEY, F.md5("thumb_data").alias("thumb_md5"),
                       F.octet_length("image_data").cast("bigint").alias("image_bytes"))


@query
def image_archives_gb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.archives_with_gb(fx.relation(spark, sf_dir, "fx_archives"))


# --- counts --------------------------------------------------------------------------


@query
def counts_per_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.counts_per_board(fx.posts(spark, sf_dir))


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of two loads."""
    posts = fx.posts(spark, sf_dir)
    first = F.col("uid") % 2 == 0
    return stored(statistics.partial(posts.where(first)).unionByName(statistics.partial(posts.where(~first))))


@query
def counts_per_board_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.counts_per_board(_partials(spark, sf_dir))


@query
def posts_per_day_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = _flagged(fx.posts(spark, sf_dir)).where("in_sample")
    return statistics.posts_per_day(_partials(spark, sf_dir), sample, *fx.PLATFORMS)


@query
def counts_per_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.counts_per_platform(fx.posts(spark, sf_dir))


@query
def image_count_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.image_count(_image_rows(spark, sf_dir), "click")


@query
def image_time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.image_time_span(_image_rows(spark, sf_dir), "click")


@query
def images_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.images_per_day(_image_rows(spark, sf_dir), "click")


# --- samples -------------------------------------------------------------------------


def _of_platforms(sizes: DataFrame) -> DataFrame:
    return sizes.where(F.col("platform").isin(*fx.PLATFORMS))


def _weighted(posts: DataFrame) -> DataFrame:
    totals = counts.counts_per_platform(posts)
    return _of_platforms(sampling.weighted_sizes(totals, SAMPLE_TOTAL))


def _flagged(posts: DataFrame) -> DataFrame:
    """Posts with ``in_sample``; the cut-offs, one row per platform, are settled first."""
    cuts = settled(sampling.cutoffs(posts, _weighted(posts), SEED))
    return sampling.flag_sample(posts, cuts, SEED)


def _sample(spark: SparkSession, sf_dir: str, sizes) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    return sampling.sample_uids(posts, sizes(counts.counts_per_platform(posts)), SEED)


@query
def sample_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, sampling.matched_sizes)


@query
def sample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, lambda totals: sampling.ratio_sizes(totals, RATIO))


@query
def sample_one_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, sampling.one_percent_sizes)


@query
def sample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, lambda totals: sampling.weighted_sizes(totals, SAMPLE_TOTAL))


@query
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    return sampling.sample_counts(sampling.sample_uids(posts, _weighted(posts), SEED))


@query
def counts_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    sizes = sampling.sample_counts(sampling.sample_uids(posts, _weighted(posts), SEED))
    return counts.counts_with_samples(counts.counts_per_platform(posts), sizes)


@query
def sample_dump_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    return plain(_flagged(posts).where("in_sample").select(*FULL_VIEW))


@query
def head_tail_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return sampling.head_and_tail(rows, "source", "doc_id", 10)


@query
def posts_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.posts_per_day(_flagged(fx.posts(spark, sf_dir)), *fx.PLATFORMS)


@query
def posts_per_day_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.posts_per_day(_flagged(fx.posts(spark, sf_dir)), *fx.PLATFORMS, spine="first")


# --- full text -----------------------------------------------------------------------


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = matching.with_tokens(fx.posts(spark, sf_dir))
    return counted.select(
        "uid", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"),
        F.col("dl").cast("bigint").alias("dl"))


EXPRESSIONS = {
    "match_term": [any_of(atom("term", "that"))],
    "match_prefix": [any_of(atom("prefix", "tion"))],
    "match_phrase": [any_of(atom("phrase", "of", "the"))],
    "match_phrase_prefix": [any_of(atom("phrase_prefix", "of", "th"))],
    "match_first": [any_of(atom("first", "the"))],
    "match_near": [any_of(atom("near", "that", "the", k=3))],
    "match_boolean": [any_of(atom("term", "that"), atom("prefix", "eau")),
                      any_of(atom("phrase", "of", "the"), atom("term", "que")),
                      none_of(atom("term", "tion"), atom("prefix", "license"))],
    "match_occurrences": [any_of(atom("prefix", "tion"), atom("phrase", "tion", "la"),
                                 atom("phrase", "la", "la"))],
}


def _found(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    markers = prepare(fx.one_marker(spark, *EXPRESSIONS[name]))
    found = matching.hits(fx.posts(spark, sf_dir), markers, ["platform"])
    f = F.aggregate("result.f", F.lit(0), lambda a, b: a + b)
    return found.select(
        "uid", "platform", f.cast("bigint").alias("hits"), F.col("spans").cast("bigint").alias("spans"))


def _register_expression(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(spark, sf_dir, name)

    run.__name__ = name
    query(run)


for _name in EXPRESSIONS:
    _register_expression(_name)


@query
def match_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = prepare(fx.one_marker(spark, any_of(atom("term", "that"), atom("prefix", "tion"))))
    ranked = ranking.ranked_hits(fx.posts(spark, sf_dir), markers, ["platform"])
    return ranked.select("uid", "platform", "rank").orderBy("rank", "uid")


@query
def match_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = prepare(fx.one_marker(spark, any_of(atom("prefix", "ee"), atom("phrase", "of", "the"))))
    found = matching.hits(fx.posts(spark, sf_dir), markers, ["body"], with_ends=True)
    marked = matching.marked_up("body", "result.spans", OPEN_TAG, CLOSE_TAG)
    return found.select("uid", F.col("spans").cast("bigint").alias("spans"), marked.alias("body"))


@query
def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = prepare(fx.one_marker(spark, any_of(atom("term", "que"))))
    rows = report.hit_rows(_flagged(fx.posts(spark, sf_dir)), markers)
    return plain(rows.drop("index", "spans"))


# --- report --------------------------------------------------------------------------


def _report(
    spark: SparkSession, sf_dir: str, rows: list[tuple] | None = None, limit: int = SMALL_MARKERS
) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    totals = settled(counts.counts_per_platform(posts))
    sizes = _of_platforms(sampling.weighted_sizes(totals, SAMPLE_TOTAL))
    cuts = settled(sampling.cutoffs(posts, sizes, SEED))
    markers = prepare(fx.markers(spark, rows), limit)
    counted = report.marker_counts(
        report.scoped_hits(sampling.flag_sample(posts, cuts, SEED), markers))
    return report.marker_report(markers, counted, totals, sampling.drawn_sizes(totals, sizes))


# Tables that several queries read, built once per session and input folder.
_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def _built(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _post_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        found = report.scoped_hits(_flagged(fx.posts(spark, sf_dir)), prepare(fx.markers(spark)))
        return stored(report.post_hits(found, fx.markers(spark)))
    return _built(spark, sf_dir, "post_hits", build)


def _hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        path = f"{checkpoint_folder(spark)}/hit-rows-{uuid.uuid4().hex}"
        rows = report.hit_rows(_flagged(fx.posts(spark, sf_dir)), prepare(fx.markers(spark)))
        tables.store_hit_rows(rows, path)
        return tables.stored_hit_rows(spark, path)
    return _built(spark, sf_dir, "hit_rows", build)


@query
def marker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query
def marker_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, fx.BROKEN_MARKERS + fx.MARKERS[:1])


@query
def marker_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = report.uid_lists(report.hit_uids(_post_hits(spark, sf_dir)), LIST_LENGTH)
    return lists.withColumn("uids", F.concat_ws(",", F.transform("uids", lambda u: u.cast("string"))))


@query
def marker_hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_hit_rows(spark, sf_dir).drop("in_all", "in_qanon", "in_sample", "spans"))


@query
def drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the rows of one scope in the folder of one marker."""
    return plain(report.drilldown(_hit_rows(spark, sf_dir), "m10", "sample"))


@query
def rollup_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_category(_report(spark, sf_dir))


@query
def rollup_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_group(_report(spark, sf_dir))


@query
def rollup_category_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.once_per_post(_post_hits(spark, sf_dir), fx.markers(spark), "category")


@query
def rollup_group_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.once_per_post(_post_hits(spark, sf_dir), fx.markers(spark), "marker_group")


@query
def heat_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.heat_scale(settled(_report(spark, sf_dir)))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the whole marker report."""
    return marker_report(spark, sf_dir)
