"""Scalar column expressions: buckets, flags, guards, casts, formatting."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbledger import config as C


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- buckets ----------------------------------------------------------------


def inclusive_bucket(c: Column | str, ranges, top: str) -> Column:
    """Label of the inclusive range that holds the value; everything else, NULL too, is `top`.

    The ranges have integer ends, so a value between two of them (100.5) is `top`.
    """
    c = as_column(c)
    out = None
    for lo, hi, label in ranges:
        hit = c.between(lo, hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(top)


def chapter_bucket(c: Column | str) -> Column:
    return inclusive_bucket(c, C.CHAPTER_RANGES, C.CHAPTER_TOP)


def balance_bucket(c: Column | str) -> Column:
    return inclusive_bucket(c, C.BALANCE_RANGES, C.BALANCE_TOP)


def half_open_bucket(c: Column | str, steps) -> Column:
    """Label of the step lo <= value < hi; the last step is open above and also the fallback."""
    c = as_column(c)
    out = None
    for lo, hi, label in steps[:-1]:
        hit = (c >= lo) & (c < hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    last = steps[-1][2]
    return F.lit(last) if out is None else out.otherwise(last)


# -- NULL defaults, flags, guards -------------------------------------------


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.when(condition, 1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 unless the whole is positive."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    """part as a percentage of the whole, and 0 unless the whole is positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def estimated_events(delta: Column, mode: Column) -> Column:
    """Events behind a spending row that carries no count. NULL mode gives NULL; mode -1 divides by zero."""
    divisor = F.when(mode == C.BIG_MODE, C.BIG_MODE_DIVISOR).otherwise(mode + 1)
    return -delta / divisor


# -- lenient casts ----------------------------------------------------------


def lenient_number(c: Column | str) -> Column:
    """The value as a double; unreadable, NULL and NaN become 0."""
    return F.coalesce(F.nullif(as_column(c).try_cast("double"), F.lit(float("nan"))), F.lit(0.0))


def lenient_number_sql(column: str) -> str:
    """lenient_number of a named column as SQL text, for long generated lists."""
    return f"coalesce(nullif(try_cast({column} AS DOUBLE), double('NaN')), 0D)"


def nearest_whole(c: Column | str) -> Column:
    """The nearest whole number, halves away from zero; a plain cast would cut the fraction off."""
    return F.round(as_column(c)).cast("bigint")


def lenient_date(c: Column | str) -> Column:
    return as_column(c).try_cast("date")


# -- dates ------------------------------------------------------------------


def as_date(value) -> date | None:
    """A plain date from a date, a datetime or an ISO string; None stays None."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, str):
        return date.fromisoformat(value)
    if isinstance(value, date):
        return value
    raise TypeError(f"not a date: {value!r}")


def date_pair(date_range) -> tuple[date, date] | None:
    """(first, last) of a usable range, else None: not a pair, or an end is missing."""
    if not isinstance(date_range, (tuple, list)) or len(date_range) != 2:
        return None
    try:
        first, last = (as_date(v) for v in date_range)
    except (TypeError, ValueError):
        return None
    return None if first is None or last is None else (first, last)


def days_before(as_of, days: int) -> Column:
    return F.date_sub(F.lit(as_date(as_of)), days)


def days_back(as_of, first: Column | str) -> Column:
    """How many days before `as_of` the date lies, counting both ends."""
    return F.datediff(F.lit(as_date(as_of)), as_column(first)) + 1


# -- number formatting ------------------------------------------------------


def money_text(c: Column | str) -> Column:
    """1234.5 -> $1,234.50"""
    return F.concat(F.lit("$"), F.format_number(as_column(c), 2))


def percent_text(c: Column | str) -> Column:
    """75.5 -> 75.50%, without thousands separators."""
    return F.concat(F.translate(F.format_number(as_column(c), 2), ",", ""), F.lit("%"))


def thousands_text(c: Column | str, places: int = 0) -> Column:
    """1234 -> 1,234"""
    return F.format_number(as_column(c), places)
