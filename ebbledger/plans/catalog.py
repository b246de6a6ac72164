"""One runnable query per operator, over the whole benchmark tables of a scale folder.

Percentages and other quotients are rounded here, for the comparison with the
checking SQL; the library itself does not round.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions import scalars as E
from ebbledger.operators import calendar, checks, filters, flows, joins, metrics, windows
from ebbledger.plans import facts, views
from ebbledger.sources import inputs as tables
from ebbledger.sources import serving, sinks
from ebbledger.sources.inputs import AS_OF, Inputs
from ebbledger.sources.versioned import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

PLACES = 4
# A range that starts before and ends after the days with data.
WIDER = (AS_OF - timedelta(days=18), AS_OF + timedelta(days=2))
INSIDE = (AS_OF - timedelta(days=10), AS_OF - timedelta(days=3))
SEGMENTS = {"first_chapter_bucket": ["11-20", "50+"], "is_us_player": [1], "paid_today_flag": []}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), PLACES) for c in columns})


def _in(spark, sf) -> Inputs:
    return tables.benchmark_inputs(spark, sf)


def _table(spark, sf, name) -> DataFrame:
    return tables.benchmark_table(spark, sf, name)


def _wide(spark, sf, **how) -> DataFrame:
    return facts.build_wide(_in(spark, sf), AS_OF, **how)


def _stored_wide(spark, sf) -> VersionedTable:
    table = VersionedTable(spark, sinks.new_path(spark, "wide"))
    table.replace(_wide(spark, sf))
    return table


def _stored_events(spark, sf) -> DataFrame:
    """The events as they lie on a cluster, a folder a day."""
    return sinks.replace_table(_in(spark, sf).events, sinks.new_path(spark, "events"))


def _long(spark, sf) -> DataFrame:
    return facts.build_long(_in(spark, sf), AS_OF)


def _served(spark, sf, segments=None) -> DataFrame:
    return serving.normalise(serving.select_segments(_wide(spark, sf), segments))


def _recent_events(spark, sf) -> DataFrame:
    return _in(spark, sf).events.where(filters.closed_open_window("date", AS_OF, C.WIDE_DAYS))


def _attributes(spark, sf) -> DataFrame:
    i = _in(spark, sf)
    return joins.bucket_attributes(i.player_days, i.players, i.fraudsters)


EVENT_KEY = ("event_id", "date", "distinct_id")

# -- scans, sources, sinks --------------------------------------------------


@query
def s1_scan_events(spark, sf):
    return tables.scan_events(_in(spark, sf).events, AS_OF, C.WIDE_DAYS)


@query
def s1_scan_stored_events(spark, sf):
    """The window over events stored by date: the folders of other days are not read."""
    return tables.scan_events(_stored_events(spark, sf), AS_OF, C.WIDE_DAYS)


@query
def s2_scan_player_days(spark, sf):
    return tables.scan_player_days(_in(spark, sf).player_days)


@query
def s3_scan_players(spark, sf):
    return tables.scan_players(_in(spark, sf).players)


@query
def s4_scan_fraudsters(spark, sf):
    return tables.scan_fraudsters(_in(spark, sf).fraudsters)


@query
def s5_load_serving(spark, sf):
    return rounded(serving.load_newest_first(_stored_wide(spark, sf), AS_OF, 7), *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def s6_sink_wide(spark, sf):
    stored = sinks.replace_table(_wide(spark, sf), sinks.new_path(spark, "wide"))
    return rounded(stored, *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def s7_sink_long(spark, sf):
    return rounded(sinks.replace_table(_long(spark, sf), sinks.new_path(spark, "long")), "cnt")


@query
def s8_available_range(spark, sf):
    return serving.available_range(_wide(spark, sf))


@query
def s9_normalise(spark, sf):
    return rounded(_served(spark, sf), *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def s10_incremental_refresh(spark, sf):
    """The table as of the day before, then only the newest day of events added to it, in one step."""
    given = _in(spark, sf)
    table = VersionedTable(spark, sinks.new_path(spark, "wide"))
    table.replace(facts.build_wide(given, AS_OF - timedelta(days=1)))
    recent = given.events.where(filters.closed_open_window("date", AS_OF, C.WIDE_DAYS))
    newest = joins.latest_batch(recent, F.col("date"))
    one_day = Inputs(newest, given.player_days, given.players, given.fraudsters)
    refreshed = table.refresh(facts.build_wide(one_day, AS_OF), [AS_OF - timedelta(days=1)])
    return rounded(refreshed, *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def s11_load_narrow(spark, sf):
    return rounded(serving.load_narrow(facts.build_narrow(_in(spark, sf), AS_OF), AS_OF, 7), "cnt")


@query
def s12_load_filtered(spark, sf):
    kept = serving.load_filtered(
        _wide(spark, sf), {"first_chapter_bucket": ["0-10", "50+"], "is_us_player": 1, "paid_ever_flag": []}
    )
    return kept.select(*C.WIDE_KEYS, "players", *C.TOTALS)


@query
def s13_load_covering(spark, sf):
    """Five days are loaded; the range asked for begins before them, and the days between are read and put below."""
    table = _stored_wide(spark, sf)
    loaded = serving.load_newest_first(table, AS_OF, 5)
    covering = serving.load_covering(table, AS_OF, (AS_OF - timedelta(days=10), AS_OF - timedelta(days=2)), loaded, 5)
    return covering.select(*C.WIDE_KEYS, "players", *C.TOTALS)


# -- projections and filters ------------------------------------------------


@query
def p1_flow_columns(spark, sf):
    rewards = _recent_events(spark, sf).where(filters.is_reward())
    return flows.as_flow(rewards, F.lit(C.INFLOW)).select("date", "distinct_id", "source", "inflow_outflow")


@query
def p2_star_and_more(spark, sf):
    i = _in(spark, sf)
    rows = flows.flows(i.events.where(filters.open_window("date", AS_OF, C.LONG_DAYS))).alias("c")
    attributes = joins.raw_attributes(i.player_days, i.players, i.fraudsters, AS_OF, C.LONG_DAYS)
    joined = rows.join(attributes, ["date", "distinct_id"], "left")
    return rounded(
        joined.select("c.*", "last_balance_of_day", E.zero_if_null("last_version_of_day").alias("last_version_of_day")),
        "cnt",
    )


@query
def f1_closed_open_window(spark, sf):
    return _recent_events(spark, sf).select(*EVENT_KEY)


@query
def f1_days_of_a_table(spark, sf):
    """Stored events of the days on which a player bought for over 300: the days are found at run time, others not read."""
    paid = tables.scan_player_days(_in(spark, sf).player_days).where(F.col("total_purchase_revenue") > 300)
    return filters.on_days(_stored_events(spark, sf), paid).select(*EVENT_KEY)


@query
def f2_open_window(spark, sf):
    return _in(spark, sf).events.where(filters.open_window("date", AS_OF, C.LONG_DAYS)).select(*EVENT_KEY)


@query
def f3_has_timestamp(spark, sf):
    return _in(spark, sf).events.where(filters.has_timestamp()).select(*EVENT_KEY)


@query
def f4_is_reward(spark, sf):
    return _in(spark, sf).events.where(filters.is_reward()).select(*EVENT_KEY, "mp_event_name")


@query
def f5_gives_credits(spark, sf):
    return _in(spark, sf).events.where(filters.gives_credits()).select(*EVENT_KEY, "item_id_1_name")


@query
def f6_is_spending(spark, sf):
    return _in(spark, sf).events.where(filters.is_spending()).select(*EVENT_KEY, "mp_event_name")


@query
def f7_country_allowed(spark, sf):
    return _in(spark, sf).events.where(filters.country_allowed("mp_country_code")).select(*EVENT_KEY, "mp_country_code")


@query
def f8_not_excluded(spark, sf):
    i = _in(spark, sf)
    return joins.not_in(i.player_days, i.fraudsters).select("date", "distinct_id")


@query
def f9_optional_side_filter(spark, sf):
    i = _in(spark, sf)
    return joins.with_player(i.player_days, i.players).select("date", "distinct_id", "first_country")


@query
def f10_between_dates(spark, sf):
    return filters.between_dates(_served(spark, sf), INSIDE).select(*C.WIDE_KEYS, *C.TOTALS)


@query
def f11_in_segments(spark, sf):
    return filters.in_segments(_served(spark, sf), SEGMENTS).select(*C.WIDE_KEYS, *C.TOTALS)


@query
def f12_filter_options(spark, sf):
    kept = [c for c in C.DIMENSIONS if c != "last_version_of_day"]
    return filters.all_filter_options(_served(spark, sf), kept)


@query
def f12_filter_options_version(spark, sf):
    return filters.filter_options(_served(spark, sf), "last_version_of_day")


@query
def f13_by_values(spark, sf):
    wanted = {"last_balance_bucket": ["0-100", "5000+"], "paid_ever_flag": 0, "is_us_player": None}
    return filters.by_values(_served(spark, sf), wanted).select(*C.WIDE_KEYS, *C.TOTALS)


@query
def f14_with_inflow(spark, sf):
    column = C.value_column("rewards_race")
    return _served(spark, sf).where(filters.with_inflow(column)).select(*C.WIDE_KEYS, column)


@query
def f15_with_any_flow(spark, sf):
    column = C.value_column("rewards_race")
    kept = _served(spark, sf).where(filters.with_any_flow(column, "total_outflow"))
    return kept.select(*C.WIDE_KEYS, column, "total_outflow")


@query
def f16_only_outflow(spark, sf):
    return filters.only_direction(_long(spark, sf), C.OUTFLOW).select("date", "distinct_id", "source", "sum_value")


# -- joins ------------------------------------------------------------------


@query
def j1_events_with_player_day(spark, sf):
    days = _in(spark, sf).player_days.where(filters.closed_open_window("date", AS_OF, C.WIDE_DAYS))
    joined = _recent_events(spark, sf).join(days, facts.PLAYER_DAY)
    return joined.select(*EVENT_KEY, "first_chapter", "last_credit_balance")


@query
def j2_events_with_player(spark, sf):
    return joins.with_player(_recent_events(spark, sf), _in(spark, sf).players).select(*EVENT_KEY, "first_country")


@query
def j3_flows_with_attributes(spark, sf):
    i = _in(spark, sf)
    rows = flows.flows(i.events.where(filters.open_window("date", AS_OF, C.LONG_DAYS)))
    attributes = joins.raw_attributes(i.player_days, i.players, i.fraudsters, AS_OF, C.LONG_DAYS)
    return rows.join(attributes, ["date", "distinct_id"], "left").select(
        "date", "distinct_id", "source", "sum_value", "first_chapter_of_day", "is_us_player"
    )


@query
def j4_player_day_attributes(spark, sf):
    i = _in(spark, sf)
    return joins.raw_attributes(i.player_days, i.players, i.fraudsters, AS_OF, C.LONG_DAYS)


@query
def j5_events_not_in_list(spark, sf):
    return joins.not_in(_recent_events(spark, sf), _in(spark, sf).fraudsters).select(*EVENT_KEY)


@query
def j6_spend_in_windows(spark, sf):
    """Credits spent within two days of a player's first generation."""
    events = _in(spark, sf).events.where(filters.has_timestamp())
    first = F.min("res_timestamp")
    opened = (
        events.where(F.col("mp_event_name") == C.GENERATION)
        .groupBy("distinct_id")
        .agg(first.alias("activity_start"), (first + F.expr("INTERVAL 2 DAYS")).alias("activity_end"))
    )
    spent = events.where(filters.is_spending()).withColumn("spent", flows.spent_credits())
    return joins.sum_in_windows(
        spent, opened, "distinct_id", "res_timestamp", "activity_start", "activity_end", "spent", "metric_during_activity"
    )


@query
def j7_latest_batch(spark, sf):
    orders = _table(spark, sf, "orders")
    newest = joins.latest_batch(orders, F.col("o_orderdate").cast("date"))
    return rounded(metrics.revenue_and_purchases(newest, ["o_custkey"], "o_totalprice"), "total_revenue")


@query
def j7_latest_batch_within(spark, sf):
    """The newest order day looked for in two weeks only."""
    orders = _table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    newest = joins.latest_batch(orders, day, day.between(F.lit("1996-03-01").cast("date"), F.lit("1996-03-14").cast("date")))
    return rounded(metrics.revenue_and_purchases(newest, ["o_custkey"], "o_totalprice"), "total_revenue")


@query
def j8_calendar_join(spark, sf):
    daily = metrics.daily_sums(_served(spark, sf), "last_balance_bucket", C.TOTALS)
    return calendar.fill_grid(daily, "last_balance_bucket", WIDER)


# -- aggregations -----------------------------------------------------------


@query
def a1_inflow(spark, sf):
    return flows.inflow(_recent_events(spark, sf)).join(_attributes(spark, sf), ["date", "distinct_id"])


@query
def a2_outflow_value(spark, sf):
    spent = flows.outflow(_recent_events(spark, sf)).join(_attributes(spark, sf), ["date", "distinct_id"])
    return spent.select("date", "distinct_id", "source", "sum_value")


@query
def a3_outflow_count(spark, sf):
    spent = flows.outflow(_recent_events(spark, sf)).join(_attributes(spark, sf), ["date", "distinct_id"])
    return rounded(spent.select("date", "distinct_id", "source", "cnt"), "cnt")


@query
def a4_explicit_grouping(spark, sf):
    i = _in(spark, sf)
    gained = flows.inflow(i.events.where(filters.open_window("date", AS_OF, C.LONG_DAYS)))
    return joins.not_in(gained, i.fraudsters)


@query
def a5_distinct_players(spark, sf):
    grouped = flows.distinct_players(_recent_events(spark, sf))
    kept = grouped.join(_attributes(spark, sf), ["date", "distinct_id"])
    return kept.select(*flows.FLOW_KEYS, "distinct_players")


@query
def a6_pivot_sources(spark, sf):
    wide = facts.player_rows(_in(spark, sf), AS_OF).select("date", "distinct_id", *C.DIMENSIONS, *C.MEASURES)
    return rounded(wide, *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def a7_roll_up(spark, sf):
    return rounded(_wide(spark, sf).drop(*C.TOTALS), *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def a8_row_totals(spark, sf):
    return facts.player_rows(_in(spark, sf), AS_OF).select("date", "distinct_id", *C.TOTALS)


@query
def a9_group_by_all_grain(spark, sf):
    return rounded(_wide(spark, sf, grain="compat"), *map(C.count_column, C.OUTFLOW_SOURCES))


@query
def a10_daily_kpis(spark, sf):
    return rounded(metrics.kpis(metrics.daily_sums(_served(spark, sf))), "consumption")


@query
def a11_daily_kpis_by_segment(spark, sf):
    d = "first_chapter_bucket"
    return rounded(metrics.kpis(metrics.daily_sums(_served(spark, sf), d), d), "consumption")


@query
def a12_free_and_paid(spark, sf):
    d = "is_us_player"
    rows = metrics.free_and_paid(metrics.daily_sums(_served(spark, sf), d), d)
    return rounded(rows, "Free Share %", "Paid Share %")


@query
def a13_free_by_source(spark, sf):
    return metrics.free_by_source(metrics.daily_sums(_served(spark, sf)))


@query
def a14_rtp_by_source(spark, sf):
    return rounded(metrics.rtp_by_source(metrics.daily_sums(_served(spark, sf))), "RTP")


@query
def a15_two_stage_rtp(spark, sf):
    return rounded(metrics.rtp_from_long(_long(spark, sf)), "rtp")


@query
def a16_flows_by_source(spark, sf):
    return rounded(metrics.flows_by_source(_long(spark, sf)), "total_count")


@query
def a17_player_net_flow(spark, sf):
    return metrics.player_net_flow(_long(spark, sf))


@query
def a18_outflow_by_segment(spark, sf):
    return metrics.outflow_by_segment(_long(spark, sf))


@query
def a19_revenue_and_purchases(spark, sf):
    paid = _table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return rounded(metrics.revenue_and_purchases(paid, ["o_custkey"], "o_totalprice"), "total_revenue")


@query
def a20_won_and_lost(spark, sf):
    return metrics.won_and_lost(_table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber")


@query
def a21_versioned_spend(spark, sf):
    i = _in(spark, sf)
    return metrics.versioned_spend_by_player(i.events, i.player_days, "last_app_version", (0.36, 0.38))


@query
def a21_versioned_spend_on_events(spark, sf):
    """The version stands on the event, so events without a player-day count too."""
    versioned = _in(spark, sf).events.withColumn("version_float", (F.col("event_id") % 5 + 35).cast("double") / 100)
    return metrics.versioned_spend(versioned, ["distinct_id"], "version_float", (0.36, 0.38))


@query
def a22_summary_table(spark, sf):
    return rounded(metrics.summary_table(_table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), "metric_1", "rate")


@query
def a22_summary_display(spark, sf):
    summary = metrics.summary_table(_table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return metrics.summary_display(summary, "o_orderpriority")


@query
def a23_global_kpis(spark, sf):
    kpis = metrics.global_kpis(_table(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "F")
    return rounded(kpis, "total_value", "rate")


@query
def a24_outflow_by_date(spark, sf):
    return metrics.outflow_by_date(_long(spark, sf))


# -- windows, order, union --------------------------------------------------


@query
def w1_player_day_outflow(spark, sf):
    return _long(spark, sf).select(
        "date", "distinct_id", "source", "inflow_outflow", "sum_value", "total_outflow_per_player_per_day"
    )


@query
def w2_share_of_day(spark, sf):
    rows = metrics.free_by_source(metrics.daily_sums(_served(spark, sf)))
    return rounded(windows.share_of_total(rows, "Free Inflow", ["date"], "Share"), "Share")


@query
def w3_segment_outflow(spark, sf):
    return rounded(facts.build_narrow(_in(spark, sf), AS_OF).select(*serving.NARROW_COLUMNS), "cnt")


@query
def o1_newest_first(spark, sf):
    return serving.load_newest_first(_stored_wide(spark, sf)).select(*C.WIDE_KEYS, "players")


@query
def o2_by_date(spark, sf):
    rows = metrics.kpis(metrics.daily_sums(_served(spark, sf), "paid_ever_flag"), "paid_ever_flag")
    return rounded(rows.orderBy("date", "paid_ever_flag"), "consumption")


@query
def o3_by_source_and_date(spark, sf):
    rows = metrics.rtp_by_source(metrics.daily_sums(_served(spark, sf)))
    return rounded(rows.orderBy("source", "date"), "RTP")


@query
def o4_by_source_and_direction(spark, sf):
    rows = _long(spark, sf).groupBy("source", "inflow_outflow").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.orderBy("source", "inflow_outflow")


@query
def u1_union_all(spark, sf):
    recent = _recent_events(spark, sf)
    return rounded(flows.combine(flows.inflow(recent), flows.outflow(recent)), "cnt")


# -- scalar functions -------------------------------------------------------


@query
def e1_chapter_bucket(spark, sf):
    return _in(spark, sf).player_days.select(
        "date", "distinct_id", E.chapter_bucket("first_chapter").alias("first_chapter_bucket")
    )


@query
def e2_balance_bucket(spark, sf):
    """Of the balance and of its quarter, which has fractions between the ranges."""
    quarter = F.col("last_credit_balance") / 4
    return _in(spark, sf).player_days.select(
        "date",
        "distinct_id",
        E.balance_bucket("last_credit_balance").alias("last_balance_bucket"),
        E.balance_bucket(quarter).alias("quarter_bucket"),
    )


@query
def e3_half_open_bucket(spark, sf):
    quarter = F.col("last_credit_balance") / 4
    return _in(spark, sf).player_days.select(
        "date",
        "distinct_id",
        E.half_open_bucket("first_chapter", C.CHAPTER_STEPS).alias("chapter_step"),
        E.half_open_bucket(quarter, C.BALANCE_STEPS).alias("balance_step"),
    )


@query
def e4_flags(spark, sf):
    return _in(spark, sf).players.select(
        "distinct_id",
        E.flag(F.col("first_country") == C.HOME_COUNTRY).alias("is_us_player"),
        E.flag(F.col("ltv_purchases") > 0).alias("paid_ever_flag"),
    )


@query
def e5_null_default(spark, sf):
    return _in(spark, sf).events.select(
        "event_id",
        E.zero_if_null("delta_credits").alias("delta_credits"),
        E.zero_if_null("bubble_cost").alias("bubble_cost"),
        E.zero_if_null("number_of_events").alias("number_of_events"),
    )


@query
def e6_guarded_percent(spark, sf):
    rows = _served(spark, sf).select(
        *C.WIDE_KEYS, E.percent(F.col("total_outflow"), F.col("total_inflow")).alias("consumption")
    )
    return rounded(rows, "consumption")


@query
def e7_sign(spark, sf):
    delta = F.col("delta_credits")
    return _in(spark, sf).events.select("event_id", F.abs(delta).alias("size"), (-delta).alias("negated"))


@query
def e8_estimated_events(spark, sf):
    estimate = E.estimated_events(F.col("delta_credits"), F.col("mode_status"))
    return rounded(_in(spark, sf).events.select("event_id", estimate.alias("estimated")), "estimated")


@query
def e9_lower(spark, sf):
    return _in(spark, sf).events.select("event_id", F.lower("item_id_1_name").alias("item"))


@query
def e10_date_arithmetic(spark, sf):
    orders = _table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey",
        F.date_sub(day, C.WIDE_DAYS).alias("window_start"),
        E.days_back(AS_OF, day).alias("days_back"),
        (day >= E.days_before(AS_OF, C.WIDE_DAYS)).cast("int").alias("in_window"),
    )


@query
def e11_lenient_casts(spark, sf):
    priority = F.col("o_orderpriority")
    text_day = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date").cast("string")).otherwise(priority)
    return _table(spark, sf, "orders").select(
        "o_orderkey",
        E.lenient_number(priority).alias("unreadable"),
        E.lenient_number(F.substring(priority, 1, 1)).alias("readable"),
        E.lenient_date(text_day).alias("day"),
    )


@query
def e12_casts_and_abs(spark, sf):
    price = F.col("o_totalprice")
    return _table(spark, sf, "orders").select(
        "o_orderkey",
        E.nearest_whole(price).alias("whole_price"),
        F.abs(E.nearest_whole(-price)).alias("whole_size"),
        F.col("o_custkey").cast("double").alias("custkey_number"),
    )


@query
def e13_number_text(spark, sf):
    return _table(spark, sf, "orders").select(
        "o_orderkey",
        E.money_text("o_totalprice").alias("money"),
        E.percent_text(F.col("o_totalprice") / 1000).alias("percentage"),
        E.thousands_text("o_custkey").alias("thousands"),
    )


@query
def e14_unusable_range(spark, sf):
    """A range with a missing end: the view falls back to the days of the data."""
    rows = views.view_consumption_trend(_served(spark, sf), "last_balance_bucket", (None, AS_OF))
    return rounded(rows, "consumption")


# -- gap fill ---------------------------------------------------------------


@query
def g1_missing_days(spark, sf):
    return rounded(views.view_consumption_trend(_served(spark, sf), None, WIDER), "consumption")


@query
def g2_missing_days_by_segment(spark, sf):
    return rounded(views.view_consumption_trend(_served(spark, sf), "last_balance_bucket", WIDER), "consumption")


@query
def g3_missing_pairs(spark, sf):
    rows = views.view_free_vs_paid(_served(spark, sf), "last_balance_bucket", WIDER)
    return rounded(rows, "Free Share %", "Paid Share %")


@query
def g4_source_grid(spark, sf):
    return rounded(views.view_free_share_by_source(_served(spark, sf), None, WIDER), "Share")


@query
def g4_source_grid_by_segment(spark, sf):
    return rounded(views.view_rtp_by_source(_served(spark, sf), "last_balance_bucket", WIDER), "RTP")


# -- views ------------------------------------------------------------------


@query
def v1_consumption_trend(spark, sf):
    return rounded(views.view_consumption_trend(_served(spark, sf)), "consumption")


@query
def v1_consumption_trend_by_chapter(spark, sf):
    return rounded(views.view_consumption_trend(_served(spark, sf), "first_chapter_bucket", WIDER), "consumption")


@query
def v2_credit_components(spark, sf):
    return rounded(views.view_credit_components(_served(spark, sf)), "consumption")


@query
def v2_credit_components_by_country(spark, sf):
    return rounded(views.view_credit_components(_served(spark, sf), "is_us_player", WIDER), "consumption")


@query
def v3_free_vs_paid(spark, sf):
    return rounded(views.view_free_vs_paid(_served(spark, sf)), "Free Share %", "Paid Share %")


@query
def v3_free_vs_paid_by_balance(spark, sf):
    rows = views.view_free_vs_paid(_served(spark, sf), "last_balance_bucket", WIDER)
    return rounded(rows, "Free Share %", "Paid Share %")


@query
def v4_free_share_by_source(spark, sf):
    return rounded(views.view_free_share_by_source(_served(spark, sf), None, WIDER), "Share")


@query
def v4_free_share_by_source_and_payer(spark, sf):
    return rounded(views.view_free_share_by_source(_served(spark, sf), "paid_ever_flag", WIDER), "Share")


@query
def v5_rtp_by_source(spark, sf):
    return rounded(views.view_rtp_by_source(_served(spark, sf), None, WIDER), "RTP")


@query
def v5_rtp_by_source_and_version(spark, sf):
    return rounded(views.view_rtp_by_source(_served(spark, sf), "last_version_of_day", WIDER), "RTP")


@query
def v6_dashboard(spark, sf):
    return rounded(views.dashboard_table(_served(spark, sf, SEGMENTS), SEGMENTS, None, INSIDE), "value")


@query
def v6_dashboard_by_payer_today(spark, sf):
    d = "paid_today_flag"
    return rounded(views.dashboard_table(_served(spark, sf, SEGMENTS), SEGMENTS, d), "value")


# -- checks -----------------------------------------------------------------


@query
def c1_days_with_data(spark, sf):
    return checks.days_with_data(_served(spark, sf), INSIDE)


@query
def c2_loaded_shape(spark, sf):
    return checks.loaded_shape(_wide(spark, sf))


@query
def c2_loaded_narrow_shape(spark, sf):
    """The narrow fact held against the wide fact's columns, which it has a part of."""
    return checks.loaded_shape(serving.load_narrow(facts.build_narrow(_in(spark, sf), AS_OF), AS_OF, 7))


@query
def c3_unbalanced_totals(spark, sf):
    return checks.unbalanced_totals(_wide(spark, sf))


@query
def c4_reconcile(spark, sf):
    common = (AS_OF - timedelta(days=C.LONG_DAYS), AS_OF - timedelta(days=1))
    return checks.reconcile(_long(spark, sf), _wide(spark, sf), common)


@query
def c5_duplicate_keys(spark, sf):
    return checks.all_duplicate_keys(_in(spark, sf))


@query
def c5_duplicate_events(spark, sf):
    return checks.duplicate_keys(_recent_events(spark, sf), ["date", "distinct_id"], "events")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v1_consumption_trend(spark, sf_dir)


__all__ = ["CATALOG", "flagship"]
