"""Known totals of the facts and views at three scales."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ebbledger.operators import flows, metrics, pivot
from ebbledger.operators.joins import bucket_attributes
from ebbledger.operators.filters import closed_open_window
from ebbledger.plans import facts
from ebbledger.sources.inputs import AS_OF, benchmark_inputs
from ebbledger.sources.serving import normalise

SCALES = ("sf0.001", "sf0.01", "sf0.1")


def _one(df, *columns):
    return tuple(df.agg(*columns).first())


@pytest.fixture(params=range(3), ids=SCALES)
def scale(request, spark):
    return request.param, benchmark_inputs(spark, f"{DATA}/{SCALES[request.param]}")


def test_flows(scale):
    n, given = scale
    recent = given.events.where(closed_open_window("date", AS_OF, 14))
    kept = bucket_attributes(given.player_days, given.players, given.fraudsters)
    rows, value = F.count(F.lit(1)), F.sum("sum_value")
    gained = flows.inflow(recent).join(kept, ["date", "distinct_id"])
    spent = flows.outflow(recent).join(kept, ["date", "distinct_id"])
    assert _one(gained, rows, F.countDistinct("source"), value, F.sum("cnt")) == [
        (42, 16, 1924, 43), (744, 19, 39155, 768), (7176, 19, 344935, 7301)
    ][n]
    unlisted = gained.where(F.col("source") == "rewards_daily")
    assert _one(unlisted, value) == [(116,), (2368,), (17586,)][n]
    assert gained.where(F.col("sum_value").isNull()).count() == [0, 15, 149][n]
    assert _one(spent, rows, value, F.round(F.sum("cnt"), 4)) == [
        (41, 2489, 472.1667), (749, 42515, 7202.1667), (6803, 391451, 70194.5)
    ][n]


def test_wide(scale):
    n, given = scale
    player_rows = facts.player_rows(given, AS_OF)
    rows = F.count(F.lit(1))
    assert _one(player_rows, rows, F.count(F.when(F.col("total_inflow").isNull(), 1))) == [
        (45, 0), (821, 2), (7652, 24)
    ][n]
    sums = (rows, F.sum("players"), F.sum("total_inflow"), F.sum("total_outflow"))
    assert _one(pivot.roll_up(player_rows), *sums) == [
        (44, 45, 1808, 2489), (755, 821, 36787, 42515), (4238, 7652, 327349, 391451)
    ][n]
    assert _one(facts.build_wide(given, AS_OF, grain="compat"), *sums) == [
        (45, 45, 1808, 2489), (820, 821, 36787, 42515), (7594, 7652, 327036, 390360)
    ][n]


def test_long(scale):
    n, given = scale
    assert _one(
        facts.build_long(given, AS_OF),
        F.count(F.lit(1)),
        F.sum("sum_value"),
        F.sum("total_outflow_per_player_per_day"),
        F.count(F.when(F.col("is_us_player").isNull(), 1)),
    ) == [(58, 3058, 4617, 19), (961, 51372, 55832, 198), (9405, 503234, 558288, 2433)][n]


def test_views(scale):
    n, given = scale
    served = normalise(facts.build_wide(given, AS_OF))
    daily = metrics.daily_sums(served)
    rows = F.count(F.lit(1))
    assert _one(metrics.kpis(daily), rows, F.round(F.sum("consumption"), 4)) == [
        (14, 12536.7210), (14, 1664.8118), (14, 1679.2015)
    ][n]
    split = metrics.daily_sums(served, "first_chapter_bucket")
    assert _one(metrics.kpis(split, "first_chapter_bucket"), rows, F.round(F.sum("consumption"), 4)) == [
        (30, 13777.6161), (56, 19940.8554), (56, 6902.8504)
    ][n]
    assert _one(metrics.free_and_paid(daily), F.round(F.sum("`Free Share %`"), 4)) == [
        (1335.6819,), (1106.1153,), (1168.0258,)
    ][n]
    assert _one(metrics.free_by_source(daily), rows, F.countDistinct("source"), F.sum("Free Inflow")) == [
        (32, 12, 1700), (197, 15, 28986), (210, 15, 273058)
    ][n]
    assert _one(metrics.rtp_by_source(daily), rows, F.round(F.sum("RTP"), 4)) == [
        (198, 911.8985), (210, 966.4629), (210, 980.0730)
    ][n]
