"""Aggregates behind the views, and the documented example queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions.scalars import money_text, nearest_whole, percent, percent_text, ratio, zero_if_null
from ebbledger.operators.filters import only_direction, with_any_flow, with_inflow

# Everything the five views read, per day and optional dimension.
DAILY_COLUMNS = C.TOTALS + tuple(C.value_column(s) for s in C.FREE_SOURCES)


def view_keys(dimension: str | None) -> tuple[str, ...]:
    C.check_dimension(dimension)
    return ("date",) if dimension is None else ("date", dimension)


def daily_sums(serving: DataFrame, dimension: str | None = None, columns=DAILY_COLUMNS) -> DataFrame:
    """Sums per day and optional dimension; rows without a day or a dimension value are left out."""
    keys = view_keys(dimension)
    sums = [F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in columns]
    return serving.dropna(subset=list(keys)).groupBy(*keys).agg(*sums)


# -- per view, from the daily sums ------------------------------------------


def kpi_columns() -> dict[str, Column]:
    spent = F.abs("total_outflow")
    return {
        "total_outflow": F.lit(0) - spent,
        "total_free_inflow": F.col("total_free_inflow"),
        "total_paid_inflow": F.col("total_paid_inflow"),
        "consumption": percent(spent, F.col("total_inflow")),
    }


def free_and_paid_columns() -> dict[str, Column]:
    free, paid, whole = F.col("total_free_inflow"), F.col("total_paid_inflow"), F.col("total_inflow")
    shares = {"Free Share %": percent(free, whole), "Paid Share %": percent(paid, whole)}
    return {"Free Inflow": free, "Paid Inflow": paid, **shares}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def kpis(daily: DataFrame, dimension: str | None = None) -> DataFrame:
    """Outflow (below zero), free and paid inflow, and outflow as a percentage of inflow."""
    return daily.select(*view_keys(dimension), *_named(kpi_columns()))


def free_and_paid(daily: DataFrame, dimension: str | None = None) -> DataFrame:
    return daily.select(*view_keys(dimension), *_named(free_and_paid_columns()))


def _free_sources() -> Column:
    """The free sources of a daily row: name, bit, and inflow."""
    rows = (f"struct('{s}' AS source, {1 << n} AS _bit, {C.value_column(s)} AS _gained)" for n, s in enumerate(C.FREE_SOURCES))
    return F.expr(f"array({', '.join(rows)})")


#: Above the bits of the free sources: whether there was any outflow.
_SPENT_BIT = 1 << len(C.FREE_SOURCES)


def source_marks() -> Column:
    """Bits of a daily row: one for each free source with inflow, one for outflow."""
    gave = F.aggregate(_free_sources(), F.lit(0), lambda bits, s: bits + F.when(with_inflow(s["_gained"]), s["_bit"]).otherwise(0))
    return gave + F.when(F.abs("total_outflow") > 0, _SPENT_BIT).otherwise(0)


def _shown(marks: str, bit: Column) -> Column:
    """Whether marks have the bit, at least one of the bits, in a calendar row."""
    return F.col("_inside") & (F.col(marks).bitwiseAND(bit) != 0)


def free_sources_shown(daily: DataFrame, dimension: str | None = None) -> Column:
    """Free inflow and share of the day, per source, as an array: (source, Free Inflow, Share).

    Sources without inflow are left out, but for those that filled rows show as zeros:
    the ones seen on any day, for the dimension values that have any.
    """
    sources = _free_sources()
    whole = F.aggregate(sources, F.lit(0.0), lambda total, s: total + F.when(with_inflow(s["_gained"]), s["_gained"].cast("double")).otherwise(0.0))
    kept = lambda s: with_inflow(s["_gained"])
    if "_all_marks" in daily.columns:
        any_free = F.col("_own_marks").bitwiseAND(F.lit(_SPENT_BIT - 1)) != 0
        kept = lambda s: with_inflow(s["_gained"]) | (any_free & _shown("_all_marks", s["_bit"]))
    gained = lambda s: F.when(with_inflow(s["_gained"]), s["_gained"]).otherwise(0)
    return F.transform(
        F.filter(sources, kept),
        lambda s: F.struct(s["source"].alias("source"), gained(s).alias("Free Inflow"), percent(gained(s), whole).alias("Share")),
    )


def rtp_sources_shown(daily: DataFrame, dimension: str | None = None) -> Column:
    """Free inflow as a percentage of outflow, per source, as an array: (source, RTP).

    Sources stay while they have inflow or there is outflow, and, in filled rows, as
    in `free_sources_shown`. Where no source is seen and there is no dimension, all are shown.
    """
    sources, spent = _free_sources(), F.abs("total_outflow")
    kept = lambda s: with_any_flow(s["_gained"], spent)
    if "_all_marks" in daily.columns:
        seen = lambda s: _shown("_all_marks", s["_bit"].bitwiseOR(F.lit(_SPENT_BIT)))
        own = F.col("_own_marks") != 0
        if dimension is None:
            own, seen = F.lit(True), lambda s, f=seen: f(s) | (F.col("_inside") & (F.col("_all_marks") == 0))
        kept = lambda s: with_any_flow(s["_gained"], spent) | (own & seen(s))
    return F.transform(
        F.filter(sources, kept), lambda s: F.struct(s["source"].alias("source"), percent(s["_gained"], spent).alias("RTP"))
    )


def free_by_source(daily: DataFrame, dimension: str | None = None) -> DataFrame:
    """Free inflow per source, sources without any left out; zeros as well in filled rows."""
    return free_share_by_source(daily, dimension).drop("Share")


def free_share_by_source(daily: DataFrame, dimension: str | None = None) -> DataFrame:
    """Free inflow per source and its share of the day, of the dimension value's day if given."""
    keys = view_keys(dimension)
    rows = daily.select(*keys, F.inline(free_sources_shown(daily, dimension)))
    return rows.select("date", "source", *keys[1:], "Free Inflow", "Share")


def rtp_by_source(daily: DataFrame, dimension: str | None = None) -> DataFrame:
    """Free inflow of a source as a percentage of all outflow; kept while either is positive, zeros as well in filled rows."""
    keys = view_keys(dimension)
    rows = daily.select(*keys, F.inline(rtp_sources_shown(daily, dimension)))
    return rows.select("date", "source", *keys[1:], "RTP")


# -- documented queries on the long fact ------------------------------------


def rtp_from_long(long_fact: DataFrame) -> DataFrame:
    """RTP per day and free source from the player-level fact, in one pass over it.

    Outflow is summed per player-day and made positive there, then per day, so
    each player-day counts once. It travels through the two aggregations as a
    row without a source, and meets the day's sources at the end, when a day
    has at most one row per source.
    """
    is_outflow = F.col("inflow_outflow") == C.OUTFLOW
    wanted = long_fact.where(is_outflow | F.col("source").isin(*C.FREE_SOURCES)).withColumn(
        "source", F.when(~is_outflow, F.col("source"))
    )
    per_player = wanted.groupBy("date", "distinct_id", "source").agg(F.sum("sum_value").alias("_value"))
    value = F.when(F.col("source").isNull(), F.abs("_value")).otherwise(F.col("_value"))
    per_day = per_player.groupBy("date", "source").agg(F.sum(value).alias("_value"))
    day = Window.partitionBy("date")
    spent = zero_if_null(F.max(F.when(F.col("source").isNull(), F.col("_value"))).over(day))
    joined = per_day.withColumn("daily_outflow", spent).where(F.col("source").isNotNull())
    gained = zero_if_null("_value")
    return joined.select(
        "date",
        "source",
        gained.alias("free_inflow"),
        "daily_outflow",
        percent(gained, F.col("daily_outflow")).alias("rtp"),
    )


def flows_by_source(long_fact: DataFrame) -> DataFrame:
    return (
        long_fact.groupBy("source", "inflow_outflow")
        .agg(F.sum("sum_value").alias("total_value"), F.sum("cnt").alias("total_count"))
        .orderBy("source", "inflow_outflow")
    )


def player_net_flow(long_fact: DataFrame) -> DataFrame:
    """Per player-day: inflow, outflow, and the plain sum of all values, whatever their sign."""
    part = lambda d: F.sum(F.when(F.col("inflow_outflow") == d, F.col("sum_value")).otherwise(0))
    return long_fact.groupBy("date", "distinct_id").agg(
        part(C.INFLOW).alias("total_inflow"),
        part(C.OUTFLOW).alias("total_outflow"),
        F.sum("sum_value").alias("net_flow"),
    )


def outflow_by_segment(long_fact: DataFrame) -> DataFrame:
    return (
        only_direction(long_fact, C.OUTFLOW)
        .groupBy("paid_ever_flag", "is_us_player", "source")
        .agg(F.sum("sum_value").alias("total_outflow"), F.countDistinct("distinct_id").alias("distinct_players"))
    )


def outflow_by_date(long_fact: DataFrame) -> DataFrame:
    """Outflow per day, made positive after the sum."""
    return only_direction(long_fact, C.OUTFLOW).groupBy("date").agg(F.abs(F.sum("sum_value")).alias("outflow"))


# -- documented patterns on any table ---------------------------------------


def revenue_and_purchases(df: DataFrame, keys, price: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(price).alias("total_revenue"), F.count(F.lit(1)).alias("total_purchases"))


def won_and_lost(df: DataFrame, keys, rank: str) -> DataFrame:
    won, lost = F.col(rank) <= C.WIN_RANK, F.col(rank) > C.WIN_RANK
    return df.groupBy(*keys).agg(
        F.count(F.when(won, 1)).alias("races_won"), F.count(F.when(lost, 1)).alias("races_lost")
    )


def _spend() -> tuple[Column, Column]:
    """A generation row's spend as stored, and multiplied by its number of events where that is known."""
    stored = F.abs(nearest_whole(zero_if_null("delta_credits")))
    number = F.col("number_of_events")
    multiplied = F.when(number.isNotNull(), stored * nearest_whole(number)).otherwise(stored)
    is_generation = F.col("mp_event_name") == C.GENERATION
    return F.when(is_generation, stored).otherwise(0), F.when(is_generation, multiplied).otherwise(0)


def _gated(version: str, gate) -> Column:
    number = F.col(version).cast("double")
    return (number >= gate[0]) & (number < gate[1])


def versioned_spend(df: DataFrame, keys, version: str, gate=C.VERSION_GATE) -> DataFrame:
    """Generation spend of events that carry their version: inside the gate it is stored per event."""
    stored, multiplied = _spend()
    spent = F.when(_gated(version, gate), multiplied).otherwise(stored)
    return df.groupBy(*keys).agg(F.sum(spent).alias("generation_credits_spent"))


def versioned_spend_by_player(
    events: DataFrame, player_days: DataFrame, version: str, gate=C.VERSION_GATE
) -> DataFrame:
    """The same where the version belongs to the player-day.

    Both readings are summed per player-day before the join, which then picks
    one, so a player with very many events brings one row per day to it.
    """
    stored, multiplied = _spend()
    per_day = events.groupBy("date", "distinct_id").agg(F.sum(stored).alias("_stored"), F.sum(multiplied).alias("_multiplied"))
    versions = player_days.select("date", "distinct_id", version)
    spent = F.when(_gated(version, gate), F.col("_multiplied")).otherwise(F.col("_stored"))
    return (
        per_day.join(versions, ["date", "distinct_id"])
        .groupBy("distinct_id")
        .agg(F.sum(spent).alias("generation_credits_spent"))
    )


def summary_table(df: DataFrame, group_by: str, value: str) -> DataFrame:
    """Per group value: sum, rows, and sum per row."""
    grouped = df.groupBy(group_by).agg(F.sum(value).alias("metric_1"), F.count(F.lit(1)).alias("metric_2"))
    return grouped.withColumn("rate", ratio(F.col("metric_1"), F.col("metric_2"))).orderBy(group_by)


def summary_display(summary: DataFrame, group_by: str) -> DataFrame:
    """The summary table with its sum as money and its rate as a percentage, both as text."""
    return summary.select(
        group_by, money_text("metric_1").alias("metric_1"), "metric_2", percent_text("rate").alias("rate")
    )


def global_kpis(df: DataFrame, value: str, counted: Column) -> DataFrame:
    """One row: rows, total, and the counted rows as a percentage of all."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(value).alias("total_value"), F.count(F.when(counted, 1)).alias("_n")
    )
    return totals.select("total_rows", "total_value", percent(F.col("_n"), F.col("total_rows")).alias("rate"))
