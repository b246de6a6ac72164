"""Joins: exclusion list, player attributes, activity windows, latest batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbledger import config as C
from ebbledger.functions.scalars import balance_bucket, chapter_bucket, flag, zero_if_null
from ebbledger.operators.filters import country_allowed, open_window

# -- exclusion --------------------------------------------------------------


def not_in(df: DataFrame, excluded: DataFrame, key: str = "distinct_id") -> DataFrame:
    """`key NOT IN (SELECT key FROM excluded)`, with SQL's NULL rules and no forced broadcast.

    Spark plans the SQL form as a null-aware join that broadcasts the list
    whatever its size.  Here the match is a plain anti join, which Spark
    broadcasts only below its size threshold, and the NULL rules are a filter.
    """
    return without(null_rules(df, excluded, key), excluded, key)


def null_rules(df: DataFrame, excluded: DataFrame, key: str = "distinct_id") -> DataFrame:
    """What NOT IN does about NULL: one in the list lets nothing pass, a NULL key passes only an empty list.

    Both facts about the list come from one small aggregate of it.
    """
    about = excluded.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keyed"))).scalar()
    has_null, is_empty = about["rows"] > about["keyed"], about["rows"] == 0
    # Two conditions, so that a later inner join on the key makes the second redundant.
    return df.where(~has_null).where(F.col(key).isNotNull() | is_empty)


def without(df: DataFrame, excluded: DataFrame, key: str = "distinct_id") -> DataFrame:
    """Plain anti join: a NULL in the list has no effect and rows with a NULL key stay."""
    return df.join(excluded.select(key), key, "left_anti")


# -- player attributes ------------------------------------------------------


def with_player(df: DataFrame, players: DataFrame) -> DataFrame:
    """Left join to the player dimension, then the country rule, which drops the rows without a player."""
    return df.join(players, "distinct_id", "left").where(country_allowed("first_country"))


def bucket_attributes(player_days: DataFrame, players: DataFrame, fraudsters: DataFrame) -> DataFrame:
    """Player-days with the six bucketed dimensions of the wide fact.

    The exclusions are applied to the player table, the smallest place that
    has the key, and reach the player-days through the join.
    """
    return with_player(player_days, not_in(players, fraudsters)).select(
        "date",
        "distinct_id",
        chapter_bucket("first_chapter").alias("first_chapter_bucket"),
        flag(F.col("first_country") == C.HOME_COUNTRY).alias("is_us_player"),
        balance_bucket("last_credit_balance").alias("last_balance_bucket"),
        zero_if_null("last_app_version").alias("last_version_of_day"),
        flag(F.col("total_purchase_revenue") > 0).alias("paid_today_flag"),
        flag(F.col("ltv_purchases") > 0).alias("paid_ever_flag"),
    )


def raw_attributes(player_days: DataFrame, players: DataFrame, fraudsters: DataFrame, as_of, days: int) -> DataFrame:
    """Player-days with the unbucketed attributes of the long fact."""
    recent = player_days.where(open_window("date", as_of, days))
    return with_player(recent, not_in(players, fraudsters)).select(
        "date",
        "distinct_id",
        F.col("first_chapter").alias("first_chapter_of_day"),
        flag(F.col("total_purchase_revenue") > 0).alias("paid_today_flag"),
        flag(F.col("ltv_purchases") > 0).alias("paid_ever_flag"),
        flag(F.col("first_country") == C.HOME_COUNTRY).alias("is_us_player"),
        F.col("last_app_version").alias("last_version_of_day"),
        F.col("last_credit_balance").alias("last_balance_of_day"),
    )


# -- activity windows -------------------------------------------------------


def _clock_seconds(c: str, kind: T.DataType) -> Column:
    """Whole seconds since the epoch, never decreasing in time: wall clock for timestamps without a zone."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_seconds(c)
    days = F.unix_date(F.col(c).cast("date")).cast("bigint")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


#: Bins of a key whose running sums are one task's; their groups are the next level.
BINS_OF_A_GROUP = 1024


def _sums_before(per_bin: DataFrame, key: str, bin_: str, sums: list[str]) -> DataFrame:
    """key, bin, and per sum `_before..`: what all earlier bins of the key hold, in two levels of running sums."""
    grouped = per_bin.withColumn("_group", F.floor(F.col(bin_) / BINS_OF_A_GROUP).cast("bigint"))
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda n, window: F.coalesce(F.sum(n).over(window), F.lit(0))
    groups = grouped.groupBy(key, "_group").agg(*(F.sum(n).alias(n) for n in sums))
    groups = groups.select(key, "_group", *(upto(n, earlier(key, by="_group")).alias(f"_groups{n}") for n in sums))
    inside = grouped.select(key, "_group", bin_, *(upto(n, earlier(key, "_group", by=bin_)).alias(f"_bins{n}") for n in sums))
    return inside.join(groups, [key, "_group"]).select(key, bin_, *((F.col(f"_bins{n}") + F.col(f"_groups{n}")).alias(f"_before{n}") for n in sums))


def sum_in_windows(
    events: DataFrame,
    windows: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    value: str,
    out: str,
    bin_seconds: int = 86400,
) -> DataFrame:
    """Per key, the sum of `value` over events with `start <= at <= end`, once for every window they fall in.

    A window's sum is the running sum at its end less the one just before its
    start. So the events of a key and the ends of its windows are put in one order
    of time, and each end adds or takes away the sum so far: as many rows as
    events and ends, whatever the number of windows an event is in or their
    length. Time is cut into bins, which spreads a key with very many events over
    tasks: sums run inside a (key, bin), over what the bins before it hold, and those
    of the bins inside groups of them, so that very many bins are spread as well.
    Sums of doubles can differ in their last digits from those taken one by one.
    """

    kind = events.schema[at].dataType
    bin_of = F.floor(_clock_seconds("_at", kind) / bin_seconds).cast("bigint").alias("_bin")
    amount = events.schema[value].dataType.simpleString()
    no_value, no_sign = F.lit(None).cast(amount).alias("_value"), F.lit(0).alias("_sign")
    ordered = windows.select(key, F.col(start).cast(kind).alias("_start"), F.col(end).cast(kind).alias("_end")).where("_start <= _end")
    points = events.where(F.col(at).isNotNull()).select(key, F.col(at).alias("_at"), F.lit(1).alias("_order"), F.col(value).alias("_value"), no_sign)
    starts = ordered.select(key, F.col("_start").alias("_at"), F.lit(0).alias("_order"), no_value, F.lit(-1).alias("_sign"))
    ends = ordered.select(key, F.col("_end").alias("_at"), F.lit(2).alias("_order"), no_value, F.lit(1).alias("_sign"))
    rows = points.unionByName(starts).unionByName(ends).where(F.col(key).isNotNull()).select("*", bin_of)
    sums = {"_sum": F.coalesce("_value", F.lit(0)), "_events": (F.col("_order") == 1).cast("bigint"), "_known": F.col("_value").isNotNull().cast("bigint")}
    per_bin = rows.groupBy(key, "_bin").agg(*(F.sum(e).alias(n) for n, e in sums.items()))
    before = _sums_before(per_bin, key, "_bin", list(sums))
    upto = Window.partitionBy(key, "_bin").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select(key, "_bin", "_sign", *(F.sum(e).over(upto).alias(n) for n, e in sums.items())).where("_sign <> 0")
    total = run.join(before, [key, "_bin"]).groupBy(key).agg(*(F.sum(F.col("_sign") * (F.col(n) + F.col(f"_before{n}"))).alias(n) for n in sums))
    return total.where("_events > 0").select(key, F.when(F.col("_known") > 0, F.col("_sum")).alias(out))


# -- latest batch -----------------------------------------------------------


def latest_batch(df: DataFrame, batch: Column, within: Column | None = None) -> DataFrame:
    """Rows of the newest batch, the newest being looked for among the rows `within`."""
    kept = df if within is None else df.where(within)
    return kept.where(batch == kept.agg(F.max(batch)).scalar())
