"""Facts on hand-written rows: the worked examples and the edge cases of the semantics."""

from datetime import date, timedelta

import pytest
from fixtures import DAY, TODAY, bubble, events, fraudsters, generation, inputs, player_days, reward
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.operators import checks, flows, pivot
from ebbledger.operators.metrics import daily_sums, kpis
from ebbledger.operators.joins import not_in, without
from ebbledger.plans.facts import build_long, build_narrow, build_wide, player_rows
from ebbledger.sources.inputs import scan_events, scan_player_days
from ebbledger.sources.serving import normalise

ESTIMATES = {0: 12.0, 1: 6.0, 2: 4.0, 3: 2.0}


@pytest.mark.parametrize("mode", ESTIMATES)
def test_estimated_count(spark, mode):
    row = flows.outflow(events(spark, [generation(-12, mode)])).first()
    assert (row.sum_value, row.cnt) == (12.0, ESTIMATES[mode])


def test_count_without_mode_is_ignored(spark):
    rows = flows.outflow(events(spark, [generation(-12, None), generation(-12, 1)]))
    assert rows.first().cnt == 6.0


def test_count_of_only_unknown_modes_is_null(spark):
    row = flows.outflow(events(spark, [generation(-12, None)])).first()
    assert (row.sum_value, row.cnt) == (12.0, None)


def test_mode_minus_one_divides_by_zero(spark):
    with pytest.raises(PySparkException, match="DIVIDE_BY_ZERO"):
        flows.outflow(events(spark, [generation(-12, -1)])).collect()


def test_recorded_count_wins_and_bubbles_count_one(spark):
    rows = flows.outflow(events(spark, [generation(-12, 1, 5), bubble(30), bubble(20)]))
    assert {r.source: (r.sum_value, r.cnt) for r in rows.collect()} == {
        "generation": (12.0, 5.0),
        "click_bubble_purchase": (50.0, 2.0),
    }


def test_one_scan_equals_two_branches(spark):
    rows = [
        reward("rewards_race", 5), reward("rewards_race", None), reward("rewards_daily", 7),
        reward("rewards_eoc", None, distinct_id="p2"), reward("rewards_eoc", 3, item_id_1_name="gems"),
        reward("Rewards_eoc", 3), reward("rewards_eoc", 3, mp_country_code=None),
        reward("rewards_eoc", 3, res_timestamp=None), reward("rewards_eoc", 3, mp_country_code="UA"),
        generation(-12, None), generation(-12, None, distinct_id="p3"), generation(None, 1, 4), bubble(30),
        bubble(9, delta_credits=-3.0, mode_status=None, distinct_id="p3"),
        {"mp_event_name": None}, {"mp_event_name": "level_up"},
    ]
    given = events(spark, rows)
    two = flows.combine(flows.inflow(given), flows.outflow(given))
    one = flows.flows(given).select(*two.columns)
    assert one.schema == two.schema or [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert two.count() == 7


def test_pivot_from_events_equals_pivot_from_flows(spark):
    """Also where a source has NULL values or counts only, alone or beside others."""
    rows = [reward(s, n) for n, s in enumerate(C.INFLOW_SOURCES)] + [
        reward("rewards_daily", 7), generation(-12, 1), bubble(30), bubble(3),
        reward("rewards_race", None, distinct_id="p3"), reward("rewards_race", None, distinct_id="p4"), reward("rewards_eoc", 2, distinct_id="p4"),
        bubble(9, delta_credits=-3.0, mode_status=None, distinct_id="p5"),
        bubble(9, delta_credits=-3.0, mode_status=None, distinct_id="p6"), generation(-12, 1, distinct_id="p6"),
        bubble(9, delta_credits=-3.0, mode_status=None, distinct_id="p7"), bubble(4, distinct_id="p7"),
    ]
    given = events(spark, rows)
    direct = pivot.pivot_events(flows.credit_moves(given), ["distinct_id", "date"])
    by_flow = pivot.pivot_sources(flows.flows(given), ["distinct_id", "date"])
    plain = lambda df: sorted(map(repr, (tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in df.select(*by_flow.columns).collect())))
    assert plain(direct) == plain(by_flow)


def test_outflow_of_either_sign_reads_the_same_in_the_views(spark):
    """Positive deltas make the outflow negative; the view shows it below zero all the same."""
    kpi = lambda delta: kpis(
        daily_sums(normalise(build_wide(inputs(spark, [reward("rewards_race", 50), generation(delta, 1, 1)]), TODAY)))
    ).first()
    assert kpi(-20) == kpi(20)
    assert kpi(20).total_outflow == -20.0 and kpi(20).consumption == 40.0


def test_text_version_is_refused(spark):
    days = player_days(spark, [{}]).withColumn("last_app_version", F.lit("1.2.3"))
    with pytest.raises(ValueError, match="last_app_version is string"):
        scan_player_days(days)


def test_long_fact_sample(spark):
    given = inputs(spark, [reward("rewards_race", 500), generation(800, 1, 4), bubble(-400)])
    rows = {r.source: r for r in build_long(given, TODAY).collect()}
    assert rows["rewards_race"].sum_value == 500.0 and rows["generation"].sum_value == -800.0
    assert {r.total_outflow_per_player_per_day for r in rows.values()} == {-1200.0}
    assert {r.is_us_player for r in rows.values()} == {1}


def test_long_keeps_players_without_attributes_wide_drops_them(spark):
    given = inputs(
        spark,
        [reward("rewards_race", 5, distinct_id=i) for i in ("p1", "noday", "noplayer", "nocountry", "abroad")],
        [{}, {"distinct_id": "noplayer"}, {"distinct_id": "nocountry"}, {"distinct_id": "abroad"}],
        [{}, {"distinct_id": "noday"}, {"distinct_id": "nocountry", "first_country": None},
         {"distinct_id": "abroad", "first_country": "UA"}],
    )
    long = {r.distinct_id: r.is_us_player for r in build_long(given, TODAY).collect()}
    assert long == {"p1": 1, "noday": None, "noplayer": None, "nocountry": None, "abroad": None}
    assert player_rows(given, TODAY).select("distinct_id").collect() == [("p1",)]


def test_windows(spark):
    days = [TODAY - timedelta(days=n) for n in (0, 1, 7, 8, 14, 15)] + [TODAY + timedelta(days=1)]
    given = inputs(
        spark,
        [reward("rewards_race", 1, date=d) for d in days],
        [{"date": d} for d in days],
    )
    wide = {r.date for r in build_wide(given, TODAY).collect()}
    assert wide == {TODAY - timedelta(days=n) for n in (1, 7, 8, 14)}
    long = {r.date for r in build_long(given, TODAY).collect()}
    assert long == {TODAY - timedelta(days=n) for n in (0, 1, 7)} | {TODAY + timedelta(days=1)}


def test_grains_differ_on_equal_totals(spark):
    given = inputs(
        spark,
        [reward("rewards_race", 10, distinct_id=i) for i in ("p1", "p2")],
        [{"distinct_id": i} for i in ("p1", "p2")],
        [{"distinct_id": i} for i in ("p1", "p2")],
    )
    column = C.value_column("rewards_race")
    pick = lambda grain: [(r.players, r[column], r.total_inflow) for r in build_wide(given, TODAY, grain=grain).collect()]
    assert pick("compat") == [(2, 20.0, 10.0)]
    assert pick("bucket") == [(2, 20.0, 20.0)]
    with pytest.raises(ValueError):
        build_wide(given, TODAY, grain="player")


def test_wide_columns_and_totals(spark):
    given = inputs(spark, [reward(s, n + 1) for n, s in enumerate(C.INFLOW_SOURCES)] + [generation(-100), bubble(7)])
    wide = build_wide(given, TODAY)
    assert wide.columns == list(C.WIDE_COLUMNS) and len(wide.columns) == 52
    row = wide.first()
    assert (row.total_inflow, row.total_paid_inflow, row.total_outflow) == (171.0, 2.0 + 3.0 + 10.0, 107.0)
    assert row.total_free_inflow == 156.0
    assert checks.unbalanced_totals(wide).first().violations == 0


def test_unlisted_source_leaves_a_row_of_zeros(spark):
    given = inputs(spark, [reward("rewards_daily", 9), reward("rewards_other", 4)])
    row = build_wide(given, TODAY).first()
    assert (row.players, row.total_inflow, row.total_outflow) == (1, 0.0, 0.0)
    assert {r.source for r in build_long(given, TODAY).collect()} == {"rewards_daily", "rewards_other"}
    assert {r.source for r in build_narrow(given, TODAY).collect()} == {"rewards_daily", "rewards_other"}


def test_null_value_stays_null_only_when_alone(spark):
    given = inputs(
        spark,
        [reward("rewards_race", None), reward("rewards_race", None, distinct_id="p2"), reward("rewards_eoc", 5, distinct_id="p2")],
        [{"distinct_id": i} for i in ("p1", "p2")],
        [{"distinct_id": i} for i in ("p1", "p2")],
    )
    column = C.value_column("rewards_race")
    rows = {r.distinct_id: (r[column], r.total_inflow) for r in player_rows(given, TODAY).collect()}
    assert rows == {"p1": (None, None), "p2": (0.0, 5.0)}


@pytest.mark.parametrize("listed", [["b"], ["b", None], [], [None], ["zzz", "zzz"]])
def test_not_in_follows_sql(spark, listed):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "distinct_id string, n int")
    excluded = fraudsters(spark, listed)
    df.createOrReplaceTempView("checked")
    excluded.createOrReplaceTempView("listed")
    expected = spark.sql("SELECT n FROM checked WHERE distinct_id NOT IN (SELECT distinct_id FROM listed)").collect()
    assert sorted(not_in(df, excluded).select("n").collect()) == sorted(expected)


def test_null_in_the_list_empties_the_facts_but_not_the_plain_anti_join(spark):
    given = inputs(spark, [reward("rewards_race", 5)], fraud_ids=("nobody", None))
    assert build_wide(given, TODAY).count() == 0 and build_long(given, TODAY).count() == 0
    assert without(given.events, given.fraudsters).count() == 1


def test_listed_player_is_left_out(spark):
    given = inputs(
        spark,
        [reward("rewards_race", 5), reward("rewards_race", 5, distinct_id="p2")],
        [{}, {"distinct_id": "p2"}],
        [{}, {"distinct_id": "p2"}],
        ["p2"],
    )
    assert build_wide(given, TODAY).first().players == 1
    assert [r.distinct_id for r in build_long(given, TODAY).collect()] == ["p1"]


def test_duplicate_player_days_multiply_as_the_join_does(spark):
    given = inputs(spark, [reward("rewards_race", 5), reward("rewards_race", 6)], [{}, {}])
    row = build_wide(given, TODAY).first()
    assert (row.players, row.total_inflow, row.rewards_race_inflow_cnt) == (1, 22.0, 4.0)
    found = checks.duplicate_keys(given.player_days, ["date", "distinct_id"], "player_days").first()
    assert (found.duplicate_keys, found.duplicate_rows) == (1, 2)


def test_narrow_repeats_segment_outflow(spark):
    given = inputs(spark, [reward("rewards_race", 5), generation(-30, 1, 2), bubble(4)])
    rows = build_narrow(given, TODAY).collect()
    assert {r.total_outflow_per_dimension_per_day for r in rows} == {34.0}
    assert {(r.source, r.sum_value, r.distinct_players) for r in rows} == {
        ("rewards_race", 5.0, 1), ("generation", 30.0, 1), ("click_bubble_purchase", 4.0, 1)
    }


def test_event_scan_windows(spark):
    days = [TODAY - timedelta(days=n) for n in (0, 1, 2, 3)]
    given = events(spark, [reward("rewards_race", 1, date=d) for d in days])
    seen = lambda *how: sorted((TODAY - r.date).days for r in scan_events(given, *how).select("date").collect())
    assert seen() == [0, 1, 2, 3]
    assert seen(TODAY, 2) == [1, 2]
    assert seen(TODAY, 2, False) == [0, 1, 2]


def test_as_of_takes_text_too(spark):
    given = inputs(spark, [reward("rewards_race", 5)])
    assert build_wide(given, "2024-01-31").first().date == DAY == date(2024, 1, 30)


def test_reconcile_is_zero(spark):
    given = inputs(
        spark,
        [reward("rewards_race", 5), reward("rewards_daily", 9), generation(-30, 1, 2), reward("rewards_race", 8, distinct_id="noday")],
    )
    found = checks.reconcile(
        build_long(given, TODAY), build_wide(given, TODAY), (TODAY - timedelta(days=7), TODAY - timedelta(days=1))
    )
    assert found.where(F.col("difference") != 0).count() == 0
    assert found.where(F.col("long_value") > 0).count() == 2
