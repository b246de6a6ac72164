"""Loading the stored facts for the views: range, columns, types, ad-hoc filters."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions.scalars import as_date, date_pair, days_before, lenient_date, lenient_number_sql
from ebbledger.sources.versioned import VersionedTable

NARROW_COLUMNS = (
    "date",
    "source",
    "inflow_outflow",
    "sum_value",
    "cnt",
    *C.DIMENSIONS,
    "total_outflow_per_dimension_per_day",
    "distinct_players",
)


def load_serving(table: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """The wide fact's 52 columns, newest day first; with `days`, only that many days back (0 is no limit).

    The dimensions break ties, so that the sort can spread one day over tasks. A
    stored table needs no such sort: `load_newest_first`.
    """
    df = table.select(*C.WIDE_COLUMNS)
    if days:
        df = df.where(F.col("date") >= days_before(as_of, days))
    return df.orderBy(F.col("date").desc(), *C.DIMENSIONS)


def load_newest_first(table: VersionedTable, as_of=None, days: int | None = None, before: date | None = None) -> DataFrame:
    """The same from a stored table, without a shuffle: its days are scanned one after the other, newest first.

    Which days there are is known from the manifest, so no other is read. The order
    of dimensions is made inside a day, by one task for each; a day of the fact has
    as many rows as segments. `before` leaves out the days from then on.
    """
    first = as_date(as_of) - timedelta(days=days) if days else date.min
    wanted = [d for d in reversed(table.days()) if first <= d and (before is None or d < before)]
    ordered = [table.read([d]).select(*C.WIDE_COLUMNS).coalesce(1).orderBy(*C.DIMENSIONS) for d in wanted]
    return reduce(DataFrame.unionAll, ordered) if ordered else table.read([]).select(*C.WIDE_COLUMNS)


def load_narrow(table: DataFrame, as_of, days: int) -> DataFrame:
    """The narrow fact's columns, every row of the last days."""
    return table.select(*NARROW_COLUMNS).where(F.col("date") >= days_before(as_of, days))


def load_filtered(table: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Rows matching ad-hoc filters: a list by membership, a value by equality; empty ones are skipped."""
    for column, wanted in (filters or {}).items():
        if wanted:
            is_list = isinstance(wanted, (list, tuple, set))
            table = table.where(F.col(column).isin(*wanted) if is_list else F.col(column) == wanted)
    return table


def normalise(df: DataFrame) -> DataFrame:
    """Plain types for the views: dates, numbers without NULL, 0/1 flags, text buckets.

    A NULL bucket becomes the text None, so its rows stay in every split.
    """
    present = set(df.columns)
    changes = {c: F.expr(lenient_number_sql(c)) for c in C.NUMERIC_COLUMNS if c in present}
    if "date" in present:
        changes["date"] = lenient_date("date")
    for c in C.FLAG_COLUMNS:
        if c in present:
            changes[c] = F.coalesce(F.col(c).cast("int"), F.lit(0))
    for c in C.BUCKET_COLUMNS:
        if c in present:
            changes[c] = F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return df.withColumns(changes)


def available_range(table: DataFrame) -> DataFrame:
    """One row: first and last day of the table."""
    return table.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def days_needed(as_of, requested_range, loaded_range) -> int | None:
    """How many days back to load so that the requested range is covered; None if it already is.

    Nothing loaded, or nothing requested, needs no reload.
    """
    requested, loaded = date_pair(requested_range), date_pair(loaded_range)
    if requested is None or loaded is None:
        return None
    if requested[0] >= loaded[0] and requested[1] <= loaded[1]:
        return None
    return (as_date(as_of) - requested[0]).days + 1


def load_covering(table: VersionedTable, as_of, requested_range, loaded: DataFrame, loaded_days: int) -> DataFrame:
    """What is `loaded`, from `loaded_days` back, and below it the older days that the requested range begins with.

    Only the missing days are read; both parts are newest first, and so is the
    whole. What counts are the days loaded, not the rows found in them: a short
    load that holds nothing is still short. 0 loaded days are all of them.
    """
    requested = date_pair(requested_range)
    start = as_date(as_of) - timedelta(days=loaded_days)
    if requested is None or not loaded_days or requested[0] >= start:
        return loaded
    back = (as_date(as_of) - requested[0]).days + 1
    return loaded.unionAll(load_newest_first(table, as_of, back, before=start))


def select_segments(table: DataFrame, segments: Mapping[str, list] | None) -> DataFrame:
    """Rows of the stored fact that match every non-empty selection, as `normalise` will show them.

    The conditions are on the stored columns, so that they reach the scan: a
    selected 0 or None also takes what is stored as NULL.
    """
    for column, values in (segments or {}).items():
        C.check_dimension(column)
        if values:
            default = "None" if column in C.BUCKET_COLUMNS else 0
            wanted = F.col(column).isin(*values)
            table = table.where(wanted | F.col(column).isNull() if default in values else wanted)
    return table
