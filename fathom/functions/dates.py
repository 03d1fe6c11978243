"""Catalogue date strings: parse with fallbacks, format, relative age.

Timestamps arrive as text and are parsed with the ``try_`` forms, so a bad
value gives null under ANSI mode instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.text import strip_ws

# Display formats.
DATE_FMT = "MMM d, yyyy"
DATETIME_FMT = "MMM d, yyyy  HH:mm"
BLANK_DATE = "—"  # em dash shown for a blank date


def _try(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern))


def parse_dataset_date(raw: Column) -> Column:
    """Dataset dates: only the first ten characters (``yyyy-M-d``) are read."""
    return _try(F.substring(strip_ws(raw), 1, 10), "yyyy-M-d")


def parse_model_date(raw: Column) -> Column:
    """Model dates: trailing Zs dropped, fraction cut to 6 digits, four forms, whole text."""
    s = F.regexp_replace(strip_ws(raw), "Z+$", "")
    s = F.regexp_replace(s, "(\\.\\d{6})\\d+", "$1")
    return F.coalesce(
        _try(s, "yyyy-M-d'T'H:m:s.SSSSSS"),
        _try(s, "yyyy-M-d'T'H:m:s"),
        _try(s, "yyyy-M-d H:m:s"),
        _try(s, "yyyy-M-d"),
    )


def parse_run_date(raw: Column) -> Column:
    """Run dates: first 19 characters in three forms, else the first ten as a date."""
    s = strip_ws(raw)
    s19 = F.substring(s, 1, 19)
    return F.coalesce(
        _try(s19, "yyyy-M-d'T'H:m:s"),
        _try(s19, "yyyy-M-d H:m:s"),
        _try(s19, "yyyy-M-d"),
        _try(F.substring(s, 1, 10), "yyyy-M-d"),
    )


def _display(raw: Column, parsed: Column, fmt: str) -> Column:
    raw = F.coalesce(raw, F.lit(""))
    return (F.when(raw == "", F.lit(BLANK_DATE))
            .when(parsed.isNotNull(), F.date_format(parsed, fmt))
            .otherwise(raw))


def relative_age(parsed: Column, as_of: str) -> Column:
    """``Today`` / ``1 day ago`` / ``n days ago`` (floor of elapsed days; future is negative).

    ``as_of`` is a parameter, never the clock, so results are repeatable.
    """
    micros = (F.unix_micros(F.to_timestamp(F.lit(as_of)))
              - F.unix_micros(parsed.cast("timestamp")))
    days = F.floor(micros / F.lit(86400 * 1_000_000)).cast("long")
    return (F.when(parsed.isNull(), F.lit(""))
            .when(days == 0, F.lit("Today"))
            .when(days == 1, F.lit("1 day ago"))
            .otherwise(F.concat(days.cast("string"), F.lit(" days ago"))))


def fmt_dataset_date(raw: Column, as_of: str) -> tuple[Column, Column]:
    p = parse_dataset_date(raw)
    return _display(raw, p, DATE_FMT), relative_age(p, as_of)


def fmt_model_date(raw: Column, as_of: str) -> tuple[Column, Column]:
    p = parse_model_date(raw)
    return _display(raw, p, DATE_FMT), relative_age(p, as_of)


def fmt_run_date(raw: Column, as_of: str) -> tuple[Column, Column]:
    p = parse_run_date(raw)
    return _display(raw, p, DATETIME_FMT), relative_age(p, as_of)
