"""Analysis job: posts and markers into samples, descriptive counts, hit rows and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import counts, report, rollups, sampling, statistics, views
from postlens.schema import BOARD_PLATFORM, FORUM_PLATFORM
from postlens.session import pin_utc
from postlens.sinks import tables
from postlens.sources.layout import settled, stored
from postlens.sources.markers import prepare

PLATFORMS = (BOARD_PLATFORM, FORUM_PLATFORM)


def sizes_for(
    mode: str, totals: DataFrame, total: int = 1_000_000, percent: dict[str, int] | None = None
) -> DataFrame:
    """Sample sizes of a mode: ``matched``, ``ratio``, ``weighted``, otherwise one percent."""
    if mode == "matched":
        return sampling.matched_sizes(totals)
    if mode == "ratio":
        return sampling.ratio_sizes(totals, percent or {})
    if mode == "weighted":
        return sampling.weighted_sizes(totals, total)
    return sampling.one_percent_sizes(totals)


def analyse(
    spark: SparkSession, posts: DataFrame, markers: DataFrame, out: str,
    mode: str = "weighted", total: int = 1_000_000, percent: dict[str, int] | None = None,
    seed: int = 0, platforms: tuple[str, str] = PLATFORMS, dryrun: bool = False,
    partials: DataFrame | None = None,
) -> DataFrame:
    """Write all results below ``out`` and return the report.

    The texts are matched once; the sample and the hit rows are stored, and every export, count,
    list and rollup is made from them.
    A dry run computes the report without writing any of it. ``partials`` are the statistics that
    the loads of these posts wrote (``tables.stored_statistics``); without them the posts are counted.
    """
    pin_utc(spark)
    partials = settled(statistics.partial(posts) if partials is None else partials)
    totals = settled(statistics.counts_per_platform(partials))
    sizes = sizes_for(mode, totals, total, percent).where(F.col("platform").isin(*platforms))
    cuts = settled(sampling.cutoffs(posts, sizes, seed))
    flagged = sampling.flag_sample(posts, cuts, seed)
    sample_sizes = sampling.drawn_sizes(totals, sizes)
    prepared = prepare(markers)

    if dryrun:
        counted = report.marker_counts(report.scoped_hits(flagged, prepared))
        return report.marker_report(prepared, counted, totals, sample_sizes)

    full = stored(views.full_view(flagged.where("in_sample")))
    tables.export_json(full.select("platform", "uid"), f"{out}/sample", by=["platform"])
    tables.export_json(full, f"{out}/sample_full_json")
    tables.export_csv(full, f"{out}/sample_full_csv")

    tables.export_json(statistics.counts_per_board(partials), f"{out}/meta/counts_per_board")
    tables.export_json(
        counts.counts_with_samples(totals, sample_sizes), f"{out}/meta/counts_per_platform")
    tables.export_json(sample_sizes, f"{out}/meta/sample_size")
    tables.export_json(
        statistics.posts_per_day(partials, full, *platforms), f"{out}/meta/distribution_per_date")

    tables.store_hit_rows(report.hit_rows(flagged, prepared, statistics.corpus(partials)), f"{out}/hit_rows")
    rows = tables.stored_hit_rows(spark, f"{out}/hit_rows")
    hits = stored(report.post_hits(rows, prepared.rows))
    counted = settled(report.scoped_counts(hits))
    result = report.marker_report(prepared, counted, totals, sample_sizes)
    tables.export_csv(result, f"{out}/analysis_csv")
    tables.export_json(result, f"{out}/analysis_json")
    tables.export_json(report.uid_lists(report.hit_uids(hits)), f"{out}/analysis_uids")
    tables.export_json(rows.drop("in_all", "in_qanon", "in_sample", "spans"), f"{out}/comments",
                       by=["index"])
    tables.export_json(rollups.by_category(result), f"{out}/rollups/category")
    tables.export_json(rollups.by_group(result), f"{out}/rollups/marker_group")
    tables.export_json(rollups.heat_scale(result), f"{out}/rollups/heat_scale")
    for level in ("category", "marker_group"):
        once = rollups.once_per_post(hits, prepared.rows, level)
        tables.export_json(once, f"{out}/rollups/{level}_once")
    return result
