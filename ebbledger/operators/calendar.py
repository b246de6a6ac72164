"""Gap fill: zero rows for days, and day combinations, that have none.

A daily frame is read once and joined to nothing. The days of a dimension value
are gathered into one row, which grows by the days of the calendar that are not
among them and is unfolded again; a frame without a dimension is one such row, as
long as the calendar. What one value has to know of the others - the ends of the
data, and which sources occur at all - each value sends to every part of the
frame, so that no task holds more than its part of the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbledger.functions.scalars import date_pair

#: Parts that the values of a dimension are dealt to, where they need facts about each other.
PARTS = 16

_OWN = ("_first", "_last", "_own_marks")
_SHARED = ("_from", "_to", "_all_marks")


def _with_shared_facts(series: DataFrame, dimension: str) -> DataFrame:
    """Adds the ends and marks of all values, by one shuffle: a value goes to one part, its facts to each of them."""
    part = F.pmod(F.hash(dimension), F.lit(PARTS))
    own = F.struct(*[F.col(c) for c in series.columns])
    sent = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS - 1)),
        lambda n: F.struct(n.alias("_part"), F.when(n == part, own).alias("_value"), *[F.col(c) for c in _OWN]),
    )
    facts = F.min("_first").alias("_from"), F.max("_last").alias("_to"), F.bit_or("_own_marks").alias("_all_marks")
    parts = series.select(F.inline(sent)).groupBy("_part").agg(F.collect_list("_value").alias("_values"), *facts)
    return parts.select(F.inline("_values"), *_SHARED)


def filled(daily: DataFrame, dimension: str | None = None, date_range=None, marks: Column | None = None) -> DataFrame:
    """The daily rows, and a row of zeros for each day of the calendar that a value has none on.

    The calendar is the range, or the data's days where the range is not usable;
    rows on other days stay. No data, no rows. Three columns are added: `_real`, false for
    the zero rows; `_inside`, whether the day is in the calendar; and, where `marks` is given,
    `_own_marks` and `_all_marks`, its bits over all days of the value and of the data.
    """
    keys = [dimension] if dimension else []
    measures = [f for f in daily.schema.fields if f.name not in ("date", *keys)]
    zeros = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in measures])
    day = F.struct("date", F.lit(True).alias("_real"), F.struct(*[f.name for f in measures]).alias("_sums"))
    pair = date_pair(date_range)
    bits = F.bit_or(F.lit(0) if marks is None else marks)
    series = daily.groupBy(*keys).agg(
        F.collect_list(day).alias("_days"), F.min("date").alias("_first"), F.max("date").alias("_last"), bits.alias("_own_marks")
    )
    if dimension and (pair is None or marks is not None):
        series = _with_shared_facts(series, dimension)
    else:
        series = series.where(F.col("_first").isNotNull()).withColumns({s: F.col(o) for o, s in zip(_OWN, _SHARED)})
    first, last = (F.col("_from"), F.col("_to")) if pair is None else (F.lit(pair[0]), F.lit(pair[1]))
    calendar = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 DAY"))).otherwise(F.array().cast("array<date>"))
    missing = F.transform(
        F.array_except(calendar, F.col("_days")["date"]),
        lambda d: F.struct(d.alias("date"), F.lit(False).alias("_real"), zeros.alias("_sums")),
    )
    kept = [*keys, *([] if marks is None else ["_own_marks", "_all_marks"])]
    rows = series.select(*kept, first.alias("_from"), last.alias("_to"), F.inline(F.concat("_days", missing)))
    inside = F.col("date").between(F.col("_from"), F.col("_to")).alias("_inside")
    return rows.select("date", "_sums.*", *kept, "_real", inside).select("date", *keys, *[f.name for f in measures], "_real", "_inside", *kept[len(keys) :])


def real_or_missing_day(dimension: str | None) -> Column:
    """Of filled rows: whether a row is real, or its day has no real row at all - holes on other days are neither.

    Without a dimension a day has one row. With one, this is a window over the day,
    whose rows are as many as the dimension's values.
    """
    if dimension is None:
        return F.lit(True)
    return F.col("_real") | ~F.max("_real").over(Window.partitionBy("date"))


def on_missing_days(rows: DataFrame, dimension: str | None) -> DataFrame:
    """The real rows of a filled frame, and the zeros of days without any."""
    return rows.withColumn("_kept", real_or_missing_day(dimension)).where("_kept").drop("_kept")


def fill_days(rows: DataFrame, date_range=None) -> DataFrame:
    """A zero row for every day without data."""
    return filled(rows, None, date_range).select(*rows.columns)


def fill_missing_days(rows: DataFrame, dimension: str, date_range=None) -> DataFrame:
    """For days without any row, a zero row per dimension value seen; holes on other days stay."""
    return on_missing_days(filled(rows, dimension, date_range), dimension).select(*rows.columns)


def fill_grid(rows: DataFrame, dimension: str, date_range=None) -> DataFrame:
    """A zero row for every missing pair of day and dimension value."""
    return filled(rows, dimension, date_range).select(*rows.columns)
