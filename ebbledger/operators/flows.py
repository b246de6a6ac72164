"""Credits gained and spent per player, day and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions.scalars import estimated_events, zero_if_null
from ebbledger.operators.filters import (
    country_allowed,
    gives_credits,
    has_timestamp,
    is_credit_event,
    is_reward,
    is_spending,
)

FLOW_KEYS = ("date", "distinct_id", "source", "inflow_outflow")


def as_flow(events: DataFrame, direction: Column) -> DataFrame:
    """Events under the fact's names: the event name is the source, the direction a new column."""
    return events.withColumnRenamed("mp_event_name", "source").withColumn("inflow_outflow", direction)


def spent_credits() -> Column:
    return -zero_if_null("delta_credits") + zero_if_null("bubble_cost")


def spending_events() -> Column:
    """Events behind one outflow row: the recorded number, or an estimate where it is missing."""
    unrecorded = F.col("number_of_events").isNull() & F.col("delta_credits").isNotNull()
    estimate = estimated_events(F.col("delta_credits"), F.col("mode_status"))
    return F.when(unrecorded, estimate).otherwise(zero_if_null("number_of_events"))


def bubble_count() -> Column:
    return F.sum(F.when(F.col("source") == C.BUBBLE, 1).otherwise(0))


def inflow(events: DataFrame) -> DataFrame:
    """Credits gained: reward events that give credits."""
    kept = events.where(has_timestamp() & country_allowed("mp_country_code") & is_reward() & gives_credits())
    return (
        as_flow(kept, F.lit(C.INFLOW))
        .groupBy(*FLOW_KEYS)
        .agg(F.sum("item_quantity_1").alias("sum_value"), F.count(F.lit(1)).alias("cnt"))
    )


def outflow(events: DataFrame) -> DataFrame:
    """Credits spent: generation and bubble purchases. The count can be fractional."""
    kept = events.where(has_timestamp() & country_allowed("mp_country_code") & is_spending())
    return (
        as_flow(kept, F.lit(C.OUTFLOW))
        .groupBy(*FLOW_KEYS)
        .agg(F.sum(spent_credits()).alias("sum_value"), (F.sum(spending_events()) + bubble_count()).alias("cnt"))
    )


def combine(gained: DataFrame, spent: DataFrame) -> DataFrame:
    """Both directions in one table; the count widens to a double."""
    return gained.withColumn("cnt", F.col("cnt").cast("double")).unionByName(
        spent.withColumn("cnt", F.col("cnt").cast("double"))
    )


def credit_moves(events: DataFrame) -> DataFrame:
    """One row per event that moves credits: how many, and how many game events it stands for.

    No spending event is a reward, so each event belongs to one direction.
    """
    gained = ~is_spending()
    return events.where(is_credit_event()).select(
        "date",
        "distinct_id",
        F.col("mp_event_name").alias("source"),
        F.when(gained, F.col("item_quantity_1")).otherwise(spent_credits()).alias("_value"),
        F.when(gained, F.lit(1.0)).otherwise(spending_events()).alias("_events"),
    )


def flows(events: DataFrame) -> DataFrame:
    """The same rows as combine(inflow, outflow), from one scan and one shuffle.

    The aggregation is partial before the shuffle: a player or source with a
    third of all events sends one row per map task.
    """
    summed = credit_moves(events).groupBy("date", "distinct_id", "source").agg(
        F.sum("_value").alias("sum_value"), (F.sum("_events") + bubble_count()).alias("cnt")
    )
    # The source decides the direction, so it stays out of the shuffle key.
    direction = F.when(F.col("source").isin(*C.OUTFLOW_SOURCES), C.OUTFLOW).otherwise(C.INFLOW)
    return summed.select("date", "distinct_id", "source", direction.alias("inflow_outflow"), "sum_value", "cnt")


def distinct_players(events: DataFrame) -> DataFrame:
    """Distinct players per flow group. The player is part of the group, so it is always 1."""
    kept = events.where(is_credit_event())
    direction = F.when(is_spending(), C.OUTFLOW).otherwise(C.INFLOW)
    rows = kept.select("date", "distinct_id", F.col("mp_event_name").alias("source"), direction.alias("inflow_outflow"))
    return rows.groupBy(*FLOW_KEYS).agg(F.countDistinct("distinct_id").alias("distinct_players"))
