"""The fact tables, built from the four inputs.

Events are reduced before anything is joined: to one row per player-day with
sources as columns for the wide fact, to one per player, day and source for the
others. That is the only shuffle that moves event-level volume, it is combined on
the map side, and in the wide build its partitioning by player and day serves the
join to the player-days too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.operators.filters import closed_open_window, open_window
from ebbledger.operators.flows import credit_moves, flows
from ebbledger.operators.joins import bucket_attributes, null_rules, raw_attributes, without
from ebbledger.operators.pivot import pivot_events, roll_up, with_totals
from ebbledger.operators.windows import player_day_outflow, segment_outflow
from ebbledger.sources.inputs import Inputs

GRAINS = ("bucket", "compat")

# The player first: sorts compare a prefix of the first key, and there are few dates but many players.
PLAYER_DAY = ["distinct_id", "date"]

LONG_COLUMNS = (
    "date",
    "distinct_id",
    "inflow_outflow",
    "source",
    "sum_value",
    "cnt",
    "total_outflow_per_player_per_day",
    "first_chapter_of_day",
    "paid_today_flag",
    "paid_ever_flag",
    "is_us_player",
    "last_version_of_day",
    "last_balance_of_day",
)


def player_flows(inputs: Inputs, as_of, days: int = C.WIDE_DAYS) -> DataFrame:
    """Flows of the window with the six dimensions of their player-day.

    Inner on (date, player): flows of a player without a player-day, of an
    excluded player or of one without an allowed country drop out.
    """
    events = inputs.events.where(closed_open_window("date", as_of, days))
    attributes = bucket_attributes(inputs.player_days, inputs.players, inputs.fraudsters)
    return flows(events).join(attributes, PLAYER_DAY)


def player_rows(inputs: Inputs, as_of, days: int = C.WIDE_DAYS) -> DataFrame:
    """One row per player-day with its six dimensions, 40 source columns and 4 totals; rows drop out as in player_flows."""
    events = inputs.events.where(closed_open_window("date", as_of, days))
    attributes = bucket_attributes(inputs.player_days, inputs.players, inputs.fraudsters)
    joined = pivot_events(credit_moves(events), PLAYER_DAY).join(attributes, PLAYER_DAY)
    # Where a player-day comes twice, its player still is one row; the join's partitioning serves this.
    one_each = joined.groupBy(*PLAYER_DAY, *C.DIMENSIONS).agg(*(F.expr(f"sum({m}) AS {m}") for m in C.MEASURES))
    return with_totals(one_each)


def build_wide(inputs: Inputs, as_of, days: int = C.WIDE_DAYS, grain: str = "bucket") -> DataFrame:
    """The wide fact: one row per day and segment, sources as columns.

    grain="bucket" sums the totals like every other measure. grain="compat"
    makes them grouping keys: rows stay close to player level, and players of
    one segment with equal totals share a row that carries those totals once.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; one of {', '.join(GRAINS)}")
    return roll_up(player_rows(inputs, as_of, days), C.TOTALS if grain == "compat" else ())


def build_long(inputs: Inputs, as_of, days: int = C.LONG_DAYS) -> DataFrame:
    """The long fact: one row per day, player, source and direction, open at the end.

    Flows of players without attributes stay, with NULL attributes. The match
    with the exclusion list comes after the aggregation, as the player is part
    of its key: the planner moves a small list down to the event scan, and a
    large one never shuffles events.
    """
    events = inputs.events.where(open_window("date", as_of, days))
    attributes = raw_attributes(inputs.player_days, inputs.players, inputs.fraudsters, as_of, days)
    kept = without(flows(null_rules(events, inputs.fraudsters)), inputs.fraudsters)
    rows = kept.join(attributes, PLAYER_DAY, "left")
    whole = player_day_outflow(rows).withColumn(
        "last_version_of_day", F.coalesce("last_version_of_day", F.lit(0))
    )
    return whole.select(*LONG_COLUMNS)


def build_narrow(inputs: Inputs, as_of, days: int = C.WIDE_DAYS) -> DataFrame:
    """The segment fact with sources as rows: value, count, players, and the segment's outflow of the day.

    The rows below are one per player and group, so counting them counts players.
    """
    keys = (*C.WIDE_KEYS, "source", "inflow_outflow")
    grouped = (
        player_flows(inputs, as_of, days)
        .groupBy(*keys)
        .agg(
            F.sum("sum_value").alias("sum_value"),
            F.sum("cnt").alias("cnt"),
            F.count("distinct_id").alias("distinct_players"),
        )
    )
    return segment_outflow(grouped)
