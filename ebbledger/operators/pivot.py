"""From one row per source to one column per source, and up to segment buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C

# The column lists are generated, so the expressions are SQL text: one call each instead of a tree of them.


def _picked(source: str, measure: str) -> Column:
    hit = f"source = '{source}' AND inflow_outflow = '{C.direction_of(source)}'"
    return F.expr(f"sum(CASE WHEN {hit} THEN {measure} ELSE 0 END)")


def pivot_sources(flows: DataFrame, keys) -> DataFrame:
    """One row per group, 40 columns: value and count of every listed source, 0 where it is absent.

    A source whose only rows carry a NULL value stays NULL when the group has
    no other row.
    """
    measures = []
    for source in C.LISTED_SOURCES:
        measures.append(_picked(source, "sum_value").alias(C.value_column(source)))
        measures.append(_picked(source, "cnt").alias(C.count_column(source)))
    return flows.groupBy(*keys).agg(*measures)


def pivot_events(rows: DataFrame, keys) -> DataFrame:
    """pivot_sources straight from single credit moves (source, _value, _events), without a row per source between.

    One aggregation, combined before its shuffle. The count of the bubble source
    is its events besides, unless all it has is unknown.
    """
    measures = []
    for source in C.LISTED_SOURCES:
        hit = f"source = '{source}'"
        count = f"sum(CASE WHEN {hit} THEN _events ELSE 0 END)"
        if source == C.BUBBLE:
            count += f" + CASE WHEN count(CASE WHEN {hit} THEN _events END) > 0 THEN count_if({hit}) ELSE 0 END"
        measures.append(F.expr(f"sum(CASE WHEN {hit} THEN _value ELSE 0 END)").alias(C.value_column(source)))
        measures.append(F.expr(count).alias(C.count_column(source)))
    return rows.groupBy(*keys).agg(*measures)


def row_totals() -> dict[str, Column]:
    """Name -> sum of the value columns of a row; NULL if one of them is."""
    return {name: F.expr(" + ".join(map(C.value_column, parts))) for name, parts in C.TOTAL_PARTS.items()}


def with_totals(pivoted: DataFrame) -> DataFrame:
    return pivoted.withColumns(row_totals())


def roll_up(player_rows: DataFrame, extra_keys=()) -> DataFrame:
    """Players and summed measures per segment bucket, totals among the measures or the keys.

    The pivot grouped by day, player and segment, so a player has one row per
    bucket and counting rows counts distinct players. That keeps the roll-up to
    one partial aggregate, one shuffle of bucket rows and one final aggregate;
    a distinct count would add two passes over the player rows.
    """
    summed = [c for c in C.MEASURES + C.TOTALS if c not in extra_keys]
    return (
        player_rows.groupBy(*C.WIDE_KEYS, *extra_keys)
        .agg(F.expr("count(distinct_id) AS players"), *[F.expr(f"sum({c}) AS {c}") for c in summed])
        .select(*C.WIDE_COLUMNS)
    )
