"""Sums repeated on every row of their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions.scalars import percent


def player_day_outflow(long_rows: DataFrame) -> DataFrame:
    """Adds the player's outflow of the day to each of that day's rows.

    A group holds one row per source of one player-day, and the join before it
    leaves the rows partitioned and sorted by this key.
    """
    spent = F.when(F.col("inflow_outflow") == C.OUTFLOW, F.col("sum_value")).otherwise(0)
    whole = Window.partitionBy("distinct_id", "date")
    return long_rows.withColumn("total_outflow_per_player_per_day", F.sum(spent).over(whole))


def share_of_total(rows: DataFrame, value: str, keys, out: str) -> DataFrame:
    """Adds each row's percentage of its group's total. A group holds at most one row per free source."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return rows.withColumn(out, percent(F.col(value), total))


def segment_outflow(narrow_rows: DataFrame, out: str = "total_outflow_per_dimension_per_day") -> DataFrame:
    """Adds the outflow of the row's day and segment to each of its rows.

    The rows are aggregated, so a group holds one row per source and direction.
    """
    spent = F.when(F.col("inflow_outflow") == C.OUTFLOW, F.col("sum_value")).otherwise(0)
    return narrow_rows.withColumn(out, F.sum(spent).over(Window.partitionBy(*C.WIDE_KEYS)))
