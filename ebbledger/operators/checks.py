"""Data checks on inputs and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.operators.filters import between_dates


def days_with_data(df: DataFrame, date_range=None) -> DataFrame:
    return between_dates(df, date_range).agg(F.countDistinct("date").alias("days_with_data"))


def loaded_shape(df: DataFrame, expected=C.WIDE_COLUMNS) -> DataFrame:
    """One row: rows, expected columns present, expected columns missing."""
    present = sum(c in df.columns for c in expected)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(present).alias("columns_present"),
        F.lit(len(expected) - present).alias("columns_missing"),
    )


def unbalanced_totals(wide: DataFrame) -> DataFrame:
    """One row: how many rows have free + paid different from total inflow. NULL totals are not compared."""
    off = F.col("total_free_inflow") + F.col("total_paid_inflow") != F.col("total_inflow")
    return wide.agg(F.count(F.when(off, 1)).alias("violations"))


def reconcile(long_fact: DataFrame, wide: DataFrame, date_range) -> DataFrame:
    """Listed sources' value by day in both facts, and the difference.

    The long fact also holds players without a player-day, which the wide one
    drops; those rows have no attributes and are left out.
    """
    matched = F.col("is_us_player").isNotNull() & F.col("source").isin(*C.LISTED_SOURCES)
    from_long = (
        between_dates(long_fact, date_range)
        .where(matched)
        .groupBy("date", "source")
        .agg(F.sum("sum_value").alias("long_value"))
    )
    summed = (
        between_dates(wide, date_range)
        .groupBy("date")
        .agg(*[F.sum(C.value_column(s)).alias(s) for s in C.LISTED_SOURCES])
    )
    from_wide = summed.unpivot(["date"], list(C.LISTED_SOURCES), "source", "wide_value")
    both = from_long.join(from_wide, ["date", "source"], "full")
    values = both.select(
        "date",
        "source",
        F.coalesce("long_value", F.lit(0)).alias("long_value"),
        F.coalesce("wide_value", F.lit(0)).alias("wide_value"),
    )
    return values.withColumn("difference", F.col("long_value") - F.col("wide_value"))


def duplicate_keys(df: DataFrame, keys, table: str) -> DataFrame:
    """One row: how many keys of the table occur more than once, and the rows they have."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .agg(
            F.lit(table).alias("table_name"),
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_rows"),
        )
    )


def all_duplicate_keys(inputs) -> DataFrame:
    parts = [
        duplicate_keys(inputs.player_days, ["date", "distinct_id"], "player_days"),
        duplicate_keys(inputs.players, ["distinct_id"], "players"),
        duplicate_keys(inputs.fraudsters, ["distinct_id"], "fraudsters"),
    ]
    return reduce(DataFrame.unionByName, parts)
