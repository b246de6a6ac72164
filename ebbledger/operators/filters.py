"""Predicates and filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions.scalars import as_column, as_date, days_before

# -- windows ----------------------------------------------------------------


def closed_open_window(c: str, as_of, days: int) -> Column:
    """The `days` days before the reference date, which itself is left out."""
    return (F.col(c) >= days_before(as_of, days)) & (F.col(c) < F.lit(as_date(as_of)))


def open_window(c: str, as_of, days: int) -> Column:
    """From `days` days before the reference date on, with no upper end."""
    return F.col(c) >= days_before(as_of, days)


def on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the days that another table names. Where rows are stored by date, Spark skips the folders of all others."""
    return rows.join(days.select("date").distinct(), "date", "left_semi")


# -- event predicates -------------------------------------------------------


def has_timestamp() -> Column:
    return F.col("res_timestamp").isNotNull()


def is_reward() -> Column:
    """Case-sensitive match of the event name."""
    return F.col("mp_event_name").contains(C.REWARD_MARK)


def gives_credits() -> Column:
    """Case-folded match of the item name."""
    return F.lower("item_id_1_name").contains(C.CREDIT_MARK)


def is_spending() -> Column:
    return F.col("mp_event_name").isin(*C.OUTFLOW_SOURCES)


def country_allowed(c: str) -> Column:
    """Not an excluded country. A NULL country is not allowed either (the test is NULL)."""
    return ~F.col(c).isin(*C.EXCLUDED_COUNTRIES)


def is_credit_event() -> Column:
    """A dated event, from an allowed country, that gains or spends credits."""
    return (
        has_timestamp()
        & country_allowed("mp_country_code")
        & ((is_reward() & gives_credits()) | is_spending())
    )


# -- filters on the facts ---------------------------------------------------


def only_direction(long_fact: DataFrame, direction: str) -> DataFrame:
    return long_fact.where(F.col("inflow_outflow") == direction)


def between_dates(df: DataFrame, date_range) -> DataFrame:
    """Rows in the range, both ends included; None filters nothing, and a None end leaves that side open.

    Anything else that is not a pair of dates raises: a misspelt date must not return everything.
    """
    if date_range is None:
        return df
    if not isinstance(date_range, (tuple, list)) or len(date_range) != 2:
        raise ValueError(f"not a pair of dates: {date_range!r}")
    first, last = (as_date(end) for end in date_range)
    if first is None and last is None:
        raise ValueError("a range needs one end at least")
    if first is not None:
        df = df.where(F.col("date") >= F.lit(first))
    return df if last is None else df.where(F.col("date") <= F.lit(last))


def in_segments(df: DataFrame, selected: Mapping[str, list] | None) -> DataFrame:
    """Rows that match every non-empty selection; an empty one filters nothing."""
    for column, values in (selected or {}).items():
        C.check_dimension(column)
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def by_values(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """A list keeps its members (an empty one keeps nothing), a value its equals, None is skipped."""
    for column, wanted in (filters or {}).items():
        if isinstance(wanted, (list, tuple, set)):
            df = df.where(F.col(column).isin(*wanted) if wanted else F.lit(False))
        elif wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of one column, sorted."""
    return df.select(column).dropna().distinct().orderBy(column)


def all_filter_options(df: DataFrame, columns=C.DIMENSIONS) -> DataFrame:
    """(dimension, value as text) of several columns in one pass over the data.

    The combinations are made distinct before they are unfolded, so the rows
    are not multiplied by the number of columns.
    """
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(*columns)
        .distinct()
        .select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dimension", "value")
    )


# -- filters on view rows ---------------------------------------------------


def with_inflow(inflow: Column | str) -> Column:
    return as_column(inflow) > 0


def with_any_flow(inflow: Column | str, outflow: Column | str) -> Column:
    return (as_column(inflow) > 0) | (as_column(outflow) > 0)
