"""Views on hand-written wide rows: gap fill, splits, empty input, and the RTP examples."""

from datetime import date

import pytest
from fixtures import DAY, TODAY, generation, inputs, reward
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.operators import metrics
from ebbledger.plans import views
from ebbledger.plans.facts import build_long, build_wide
from ebbledger.sources.serving import normalise

D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
RANGE = (D1, D3)
DIM = "first_chapter_bucket"


def wide(spark, rows):
    """Normalised wide rows from dicts of source values; totals follow."""
    names = ["date", "first_chapter_bucket", "is_us_player", *[C.value_column(s) for s in C.LISTED_SOURCES]]
    data = []
    for day, bucket, values in rows:
        cells = [float(values.get(s, 0)) for s in C.LISTED_SOURCES]
        data.append((day, bucket, 1, *cells))
    schema = "date date, first_chapter_bucket string, is_us_player int, " + ", ".join(f"{n} double" for n in names[3:])
    df = spark.createDataFrame(data, schema)
    for total, parts in C.TOTAL_PARTS.items():
        df = df.withColumn(total, sum((F.col(C.value_column(s)) for s in parts), F.lit(0.0)))
    return df


@pytest.fixture(scope="module")
def gaps(spark):
    """X on days 1 and 3, Y only on day 1."""
    return wide(
        spark,
        [
            (D1, "X", {"rewards_race": 30, "rewards_store": 10, "generation": 20}),
            (D1, "Y", {"rewards_eoc": 5, "generation": 50}),
            (D3, "X", {"rewards_race": 8, "click_bubble_purchase": 4}),
        ],
    )


def test_trend_values(gaps):
    rows = {r.date: r for r in views.view_consumption_trend(gaps).collect()}
    assert rows[D1].total_outflow == -70.0 and rows[D1].total_free_inflow == 35.0 and rows[D1].total_paid_inflow == 10.0
    assert rows[D1].consumption == pytest.approx(70 / 45 * 100)
    assert tuple(rows[D2]) == (D2, 0.0, 0.0, 0.0, 0.0)


def test_trend_range(gaps):
    days = lambda r: [x.date for x in views.view_consumption_trend(gaps, None, r).collect()]
    assert days(None) == [D1, D2, D3]
    assert days((D1, None)) == [D1, D2, D3] == days((D1,)) == days("data")
    assert days((D2, date(2024, 1, 4))) == [D1, D2, D3, date(2024, 1, 4)]
    assert days((D3, D2)) == [D1, D3]


def test_trend_split_fills_only_missing_days(gaps):
    got = [(r.date, r[DIM]) for r in views.view_consumption_trend(gaps, DIM, RANGE).collect()]
    assert got == [(D1, "X"), (D1, "Y"), (D2, "X"), (D2, "Y"), (D3, "X")]


def test_components_add_up(gaps):
    rows = views.view_credit_components(gaps, DIM, RANGE).collect()
    assert [r.total_inflow for r in rows] == [40.0, 5.0, 0.0, 0.0, 8.0]


def test_free_vs_paid_split_fills_pairs(gaps):
    got = [(r.date, r[DIM], r["Free Share %"]) for r in views.view_free_vs_paid(gaps, DIM, RANGE).collect()]
    assert got == [(D1, "X", 75.0), (D1, "Y", 100.0), (D2, "X", 0.0), (D2, "Y", 0.0), (D3, "X", 100.0), (D3, "Y", 0.0)]
    assert [r.date for r in views.view_free_vs_paid(gaps).collect()] == [D1, D3]


def test_free_share_grid(gaps):
    rows = views.view_free_share_by_source(gaps, None, RANGE).collect()
    assert [(r.date, r.source) for r in rows] == [(d, s) for d in RANGE_DAYS for s in ("rewards_eoc", "rewards_race")]
    shares = {(r.date, r.source): r.Share for r in rows}
    assert shares[D1, "rewards_race"] == pytest.approx(30 / 35 * 100) and shares[D2, "rewards_race"] == 0.0
    split = views.view_free_share_by_source(gaps, DIM, RANGE)
    assert split.count() == 3 * 2 * 2
    assert views.view_free_share_by_source(gaps).count() == 3


RANGE_DAYS = (D1, D2, D3)


def test_rtp_grid(gaps):
    rows = views.view_rtp_by_source(gaps, None, RANGE).collect()
    assert len(rows) == 3 * 15
    values = {(r.date, r.source): r.RTP for r in rows}
    assert values[D1, "rewards_race"] == pytest.approx(30 / 70 * 100) and values[D3, "rewards_race"] == 200.0


def test_no_source_row_survives(spark):
    """Only paid inflow and no outflow: no free share rows, but unsplit RTP shows every source at zero."""
    df = wide(spark, [(D1, "X", {"rewards_store": 10})])
    assert views.view_free_share_by_source(df, None, RANGE).count() == 0
    assert views.view_free_share_by_source(df, DIM, RANGE).columns == ["date", "source", DIM, "Free Inflow", "Share"]
    assert views.view_rtp_by_source(df, DIM, RANGE).count() == 0
    unsplit = views.view_rtp_by_source(df, None, RANGE)
    assert unsplit.count() == 3 * 15 and unsplit.where("RTP <> 0").count() == 0


@pytest.mark.parametrize("dimension", [None, DIM])
def test_empty_input_gives_empty_views(gaps, dimension):
    none = gaps.where(F.lit(False))
    for view in (
        views.view_consumption_trend,
        views.view_credit_components,
        views.view_free_vs_paid,
        views.view_free_share_by_source,
        views.view_rtp_by_source,
    ):
        assert view(none, dimension, RANGE).collect() == []
    assert all(v.count() == 0 for v in views.dashboard(none, None, dimension, RANGE).values())


def test_dashboard_filters_then_fills(gaps):
    shown = views.dashboard(gaps, {DIM: ["Y"], "is_us_player": []}, None, RANGE)
    assert [(r.date, r.total_outflow) for r in shown["consumption_trend"].collect()] == [(D1, -50.0), (D2, 0.0), (D3, 0.0)]
    whole = views.dashboard(gaps)
    assert {k: v.count() for k, v in whole.items()} == {
        "consumption_trend": 3, "credit_components": 3, "free_vs_paid": 3, "free_share_by_source": 6, "rtp_by_source": 45
    }
    with pytest.raises(ValueError):
        views.dashboard(gaps, {"distinct_id": ["p1"]})
    with pytest.raises(ValueError):
        views.view_consumption_trend(gaps, "distinct_id")


@pytest.mark.parametrize("dimension", [None, DIM])
@pytest.mark.parametrize("over", [None, RANGE, (D2, date(2024, 1, 5)), (D3, D2)])
def test_dashboard_as_one_table(gaps, dimension, over):
    """One pass gives the rows of the five panels, each alone."""
    for segments in (None, {DIM: ["Y"]}):
        table = views.dashboard_table(gaps, segments, dimension, over)
        panels = views.stacked(views.dashboard(gaps, segments, dimension, over), dimension)
        assert table.columns == panels.columns
        key = lambda r: tuple(str(c) for c in r)
        assert sorted(table.collect(), key=key) == sorted(panels.collect(), key=key)


def test_sources_seen_under_one_value_are_shown_under_another(gaps):
    """Y has no inflow of rewards_race, X has; X has none of rewards_eoc; a value without free inflow is not shown."""
    more = gaps.unionByName(wide(gaps.sparkSession, [(D2, "Z", {"rewards_store": 4})]))
    rows = views.view_free_share_by_source(more, DIM, "data").collect()
    assert {(r[DIM], r.source) for r in rows} == {(v, s) for v in "XY" for s in ("rewards_eoc", "rewards_race")}
    assert len(rows) == 2 * 2 * 3 and sum(r["Free Inflow"] for r in rows) == 43


def test_null_dimension_rows_are_left_out_unless_normalised(spark):
    df = wide(spark, [(D1, "X", {"rewards_race": 1}), (D1, None, {"rewards_race": 2})])
    assert [r[DIM] for r in metrics.daily_sums(df, DIM).collect()] == ["X"]
    assert {r[DIM] for r in metrics.daily_sums(normalise(df), DIM).collect()} == {"X", "None"}


def _rtp(spark, players, event_rows):
    given = inputs(spark, event_rows, [{"distinct_id": p} for p in players], [{"distinct_id": p} for p in players])
    from_wide = views.view_rtp_by_source(normalise(build_wide(given, TODAY)))
    from_long = metrics.rtp_from_long(build_long(given, TODAY))
    wide_rtp = {r.source: r.RTP for r in from_wide.where("RTP > 0").collect()}
    long_rtp = {r.source: r.rtp for r in from_long.collect()}
    assert wide_rtp == pytest.approx(long_rtp)
    return {k: round(v, 2) for k, v in long_rtp.items()}, from_long.first().daily_outflow


def test_rtp_one_player(spark):
    got, outflow = _rtp(
        spark,
        ["p1"],
        [reward("rewards_timed_task", 1000), reward("rewards_harvest_collect", 500), reward("rewards_board_task", 300),
         generation(2000, 1, 1)],
    )
    assert outflow == 2000.0
    assert got == {"rewards_timed_task": 50.0, "rewards_harvest_collect": 25.0, "rewards_board_task": 15.0}


def test_rtp_two_players(spark):
    rows = []
    for player, timed, harvest, spent in (("p1", 1000, 500, 2000), ("p2", 800, 400, 1500)):
        rows += [
            reward("rewards_timed_task", timed, distinct_id=player),
            reward("rewards_harvest_collect", harvest, distinct_id=player),
            generation(spent, 1, 1, distinct_id=player),
        ]
    got, outflow = _rtp(spark, ["p1", "p2"], rows)
    assert outflow == 3500.0
    assert got == {"rewards_timed_task": 51.43, "rewards_harvest_collect": 25.71}


def test_day_is_the_fixture_day(spark):
    given = inputs(spark, [reward("rewards_race", 1)])
    assert views.view_consumption_trend(normalise(build_wide(given, TODAY))).first().date == DAY
