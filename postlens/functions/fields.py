"""Small column helpers for raw fields, times and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the input formats.
QUOTED_PARENT = "^>>([0-9]+)"
MISSING = "N"
DUMP_NAME = r"/([a-zA-Z0-9]+)(_[0-9]+)?\.csv(\.gz)?"


def parent_from_quote(body: Column) -> Column:
    """Post id quoted at the very start of a body (``>>123``), else null."""
    return F.nullif(F.regexp_extract(body, QUOTED_PARENT, 1), F.lit(""))


def null_marker(text: Column) -> Column:
    """The dump writes a missing value as ``N``."""
    return F.nullif(text, F.lit(MISSING))


def board_from_path(path: Column) -> Column:
    """``.../pol_01.csv.gz`` and ``.../pol.csv`` both name the board ``/pol/``."""
    name = F.nullif(F.regexp_extract(path, DUMP_NAME, 1), F.lit(""))
    return F.concat(F.lit("/"), name, F.lit("/"))


def digits(text: Column) -> Column:
    """Number formed by the digits of a text, null without digits."""
    return F.regexp_replace(text, r"\D", "").try_cast("bigint")


def epoch_seconds(text: Column) -> Column:
    """Whole epoch seconds from a raw field, null if it is no number."""
    return F.trim(text).try_cast("bigint")


def number_seconds(text: Column) -> Column:
    """Whole epoch seconds from a JSON number in any spelling (``1.5e9``, ``1509134400.0``)."""
    return F.trim(text).try_cast("decimal(38,6)").cast("bigint")


def day(epoch: Column) -> Column:
    """UTC day of epoch seconds as ``yyyy-MM-dd``."""
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int")).cast("string")


def utc_text(epoch: Column) -> Column:
    """UTC time of epoch seconds as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def range_bound(iso_time: str) -> Column:
    """Epoch seconds of an ISO time without zone, read as UTC."""
    return F.unix_timestamp(F.lit(iso_time.replace("T", " ")), "yyyy-MM-dd HH:mm:ss")


def within(epoch: Column, start: str | None, end: str | None) -> Column:
    """Both ends inclusive; a missing end is open."""
    inside = F.lit(True)
    if start is not None:
        inside &= epoch >= range_bound(start)
    if end is not None:
        inside &= epoch <= range_bound(end)
    return inside


def share_text(part: Column, whole: Column) -> Column:
    """``part / whole`` with ten decimals as text, ``-1`` if there is no whole."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when(share.isNotNull(), F.format_string("%.10f", share)).otherwise(F.lit("-1"))
