"""Scalar functions, filters, joins, loading and sinks on small rows."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.functions import scalars as E
from ebbledger.operators import checks, filters, joins, metrics
from ebbledger.sources import schemas, serving, sinks
from ebbledger.sources.versioned import VersionedTable

CHAPTERS = {0: "0-10", 10: "0-10", 11: "11-20", 20: "11-20", 21: "21-50", 50: "21-50", 51: "50+", None: "50+", -1: "50+"}
BALANCES = {
    0.0: "0-100", 100.0: "0-100", 101.0: "101-300", 300.0: "101-300", 301.0: "301-500", 500.0: "301-500",
    501.0: "501-1000", 1000.0: "501-1000", 1001.0: "1001-3000", 3000.0: "1001-3000", 3001.0: "3001-5000",
    5000.0: "3001-5000", 5001.0: "5000+", None: "5000+", 100.5: "5000+",
}


def _apply(spark, values, kind, make):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(make("v").alias("out")).collect()]


def test_chapter_buckets(spark):
    assert _apply(spark, CHAPTERS, "bigint", E.chapter_bucket) == list(CHAPTERS.values())


def test_balance_buckets(spark):
    assert _apply(spark, BALANCES, "double", E.balance_bucket) == list(BALANCES.values())


def test_half_open_buckets_have_no_gaps(spark):
    steps = {0.0: "0-100", 100.5: "0-100", 101.0: "101-300", 5000.9: "3001-5000", 5001.0: "5000+", -1.0: "5000+", None: "5000+"}
    assert _apply(spark, steps, "double", lambda c: E.half_open_bucket(c, C.BALANCE_STEPS)) == list(steps.values())
    chapters = {10: "0-10", 11: "11-20", 50: "21-50", 51: "50+", -1: "50+"}
    assert _apply(spark, chapters, "int", lambda c: E.half_open_bucket(c, C.CHAPTER_STEPS)) == list(chapters.values())


def test_lenient_casts(spark):
    assert _apply(spark, ["1.5", "x", None, "NaN", ""], "string", E.lenient_number) == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert _apply(spark, ["2024-01-05", "x", None], "string", E.lenient_date) == [date(2024, 1, 5), None, None]


def test_nearest_whole_goes_away_from_zero(spark):
    assert _apply(spark, [1.4, 1.5, -1.5, -1.4, None], "double", E.nearest_whole) == [1, 2, -2, -1, None]


def test_percent_guard(spark):
    df = spark.createDataFrame([(5.0, 10.0), (5.0, 0.0), (5.0, -1.0), (5.0, None)], "a double, b double")
    assert [r[0] for r in df.select(E.percent(F.col("a"), F.col("b"))).collect()] == [50.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("value", [0.0, 0.125, 2.675, 1234.5, -5.0, 1234567.891, 0.005])
def test_number_text_reads_like_plain_formatting(spark, value):
    money, share, thousands = _apply(
        spark, [value], "double", lambda c: F.array(E.money_text(c), E.percent_text(c), E.thousands_text(c, 2))
    )[0]
    assert (money, share, thousands) == (f"${value:,.2f}", f"{value:.2f}%", f"{value:,.2f}")


def test_date_pair():
    day, other = date(2024, 1, 1), date(2024, 1, 2)
    assert E.date_pair((day, other)) == (day, other) == E.date_pair(["2024-01-01", datetime(2024, 1, 2, 5)])
    for bad in (None, (), (day,), (day, None), (day, other, day), "data", (day, 5), ("x", day)):
        assert E.date_pair(bad) is None


def test_filters_differ_on_empty_values(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), (None, 2)], "k string, n int")
    count = lambda f: f.count()
    assert count(filters.by_values(df, {"k": ["a"], "n": None})) == 1
    assert count(filters.by_values(df, {"n": 0})) == 1
    assert count(filters.by_values(df, {"k": []})) == 0
    assert count(serving.load_filtered(df, {"k": [], "n": 0})) == 3
    assert count(serving.load_filtered(df, {"k": ["a", "b"], "n": 1})) == 1
    assert [r[0] for r in filters.filter_options(df, "k").collect()] == ["a", "b"]


def test_null_country_is_not_allowed(spark):
    df = spark.createDataFrame([("US",), ("UA",), (None,)], "c string")
    assert [r[0] for r in df.where(filters.country_allowed("c")).collect()] == ["US"]


def test_reload_days():
    today = date(2024, 1, 31)
    loaded = (date(2024, 1, 20), date(2024, 1, 30))
    assert serving.days_needed(today, (date(2024, 1, 21), date(2024, 1, 29)), loaded) is None
    assert serving.days_needed(today, (date(2024, 1, 15), date(2024, 1, 29)), loaded) == 17
    assert serving.days_needed(today, (date(2024, 1, 25), date(2024, 2, 2)), loaded) == 7
    assert serving.days_needed(today, None, loaded) is None
    assert serving.days_needed(today, (date(2024, 1, 15), today), (None, None)) is None


def test_schema_check(spark):
    with pytest.raises(ValueError, match="distinct_id is missing"):
        schemas.check_schema(spark.createDataFrame([(1,)], "x int"), schemas.FRAUDSTERS, "fraudsters")
    with pytest.raises(ValueError, match="distinct_id is int"):
        schemas.check_schema(spark.createDataFrame([(1,)], "distinct_id int"), schemas.FRAUDSTERS, "fraudsters")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bin_seconds", [3600, 86400])
def test_sum_in_windows_equals_brute_force(spark, seed, bin_seconds):
    """Many events and windows on few keys, ends on bin edges, overlapping and backward windows."""
    rng = random.Random(seed)
    begin = datetime(2024, 1, 1)
    at = lambda: begin + timedelta(minutes=rng.choice([rng.randrange(0, 7200), 60 * rng.randrange(0, 120)]))
    keys = ["hot"] * 6 + ["a", "b", None]
    events = [(rng.choice(keys), at(), rng.choice([None, 1, 5, -3])) for _ in range(300)] + [("a", None, 9)]
    windows = [(rng.choice(keys), at(), at()) for _ in range(40)]
    expected = {}
    for key, when, value in events:
        for owner, start, end in windows:
            if key is not None and key == owner and when is not None and start <= when <= end:
                seen = expected.setdefault(key, [])
                seen.append(value)
    expected = {k: (sum(v for v in vs if v is not None) if any(v is not None for v in vs) else None) for k, vs in expected.items()}
    got = joins.sum_in_windows(
        spark.createDataFrame(events, "k string, t timestamp, v bigint"),
        spark.createDataFrame(windows, "k string, s timestamp, e timestamp"),
        "k", "t", "s", "e", "v", "total", bin_seconds,
    )
    assert {r.k: r.total for r in got.collect()} == expected


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sum_in_windows_across_a_clock_change(spark, kind):
    """Hourly bins around the days the clocks change, against the plain range join."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rng = random.Random(7)
        for day in ("2024-03-09T20:00:00", "2024-11-02T20:00:00"):
            begin = datetime.fromisoformat(day)
            at = lambda: (begin + timedelta(minutes=rng.randrange(0, 900))).isoformat()
            events = spark.createDataFrame([("k", at(), 1) for _ in range(200)], "k string, t string, v bigint")
            windows = spark.createDataFrame([("k", at(), at()) for _ in range(60)], "k string, s string, e string")
            events = events.withColumn("t", F.col("t").cast(kind))
            windows = windows.withColumns({c: F.col(c).cast(kind) for c in ("s", "e")})
            plain = windows.join(events, "k").where("t BETWEEN s AND e").agg(F.sum("v")).first()[0]
            got = joins.sum_in_windows(events, windows, "k", "t", "s", "e", "v", "total", 3600).first().total
            assert got == plain > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_latest_batch(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "batch int, v string")
    assert [r.v for r in joins.latest_batch(df, F.col("batch")).collect()] == ["d"]
    assert sorted(r.v for r in joins.latest_batch(df, F.col("batch"), F.col("batch") < 3).collect()) == ["b", "c"]


def test_versioned_spend(spark):
    rows = [
        ("p", "generation", -10.0, 3, "0.357"), ("p", "generation", -10.0, 3, "0.3593"),
        ("p", "generation", -10.0, None, "0.358"), ("p", "generation", None, 3, "0.358"), ("p", "view", -99.0, 3, "0.358"),
    ]
    df = spark.createDataFrame(
        rows, "distinct_id string, mp_event_name string, delta_credits double, number_of_events int, version string"
    )
    assert metrics.versioned_spend(df, ["distinct_id"], "version").first().generation_credits_spent == 30 + 10 + 10


D1, D2, D3 = (date(2024, 1, n) for n in (1, 2, 3))


@pytest.fixture
def versioned(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "fact"))
    table.replace(days_frame(spark, [(1, D1), (2, D2)]))
    return table


def days_frame(spark, rows):
    return spark.createDataFrame(rows, "v int, date date")


def held(df):
    return sorted((r.v, r.date) for r in df.collect())


def test_replace_refuses_its_own_source(spark, tmp_path):
    path = str(tmp_path / "fact")
    table = sinks.replace_table(days_frame(spark, [(1, D1), (2, D2)]), path)
    assert table.columns == ["v", "date"] and held(table) == [(1, D1), (2, D2)]
    with pytest.raises(ValueError, match="reads"):
        sinks.replace_table(table, path)
    assert held(sinks.replace_table(days_frame(spark, [(7, D3)]), path)) == [(7, D3)]


def test_refresh_replaces_the_stated_days(spark, versioned):
    for _ in range(2):
        table = versioned.refresh(days_frame(spark, [(20, D2), (30, D3)]), [D2, "2024-01-03"])
        assert held(table) == [(1, D1), (20, D2), (30, D3)] and table.columns == ["v", "date"]
    assert held(versioned.refresh(days_frame(spark, [(99, D1)]), [D2])) == [(1, D1), (30, D3)]  # D2 has no rows, D1 is not stated
    assert held(versioned.refresh(days_frame(spark, []), [D3])) == [(1, D1)] and versioned.days() == [D1]
    assert held(versioned.refresh(versioned.read().selectExpr("v + 1 AS v", "date"), [D1])) == [(2, D1)]  # reads itself
    assert held(versioned.refresh(days_frame(spark, [(5, D2)]), [])) == [(2, D1)]
    with pytest.raises(ValueError, match="columns"):
        versioned.refresh(spark.createDataFrame([("x", D1)], "v string, date date"), [D1])
    assert held(versioned.refresh(days_frame(spark, []), [D1])) == [] == versioned.days()
    assert [tuple(r) for r in versioned.replace(days_frame(spark, [(4, None)])).collect()] == [(4, None)]


def test_a_refresh_that_stops_leaves_the_old_table(spark, versioned, monkeypatch):
    """The new files are there and the switch did not come: readers have the table before. A reader of before keeps its files after."""
    before = versioned.read()

    def stopped(self, manifest):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_switch", stopped)
        with pytest.raises(OSError):
            versioned.refresh(days_frame(spark, [(20, D2), (30, D3)]), [D2, D3])
    assert held(versioned.read()) == [(1, D1), (2, D2)]
    assert held(versioned.refresh(days_frame(spark, [(20, D2)]), [D1, D2])) == [(20, D2)]
    assert held(before) == [(1, D1), (2, D2)]
    assert versioned.vacuum() == 5 and held(versioned.read()) == [(20, D2)]  # 4 unused versions, 1 manifest
    assert versioned.vacuum() == 0


def test_refreshes_at_a_time_keep_each_others_days(spark, versioned, monkeypatch):
    """Another refresh takes the next number between reading the manifest and the switch."""
    plain, taken = VersionedTable._switch, []

    def late(self, manifest):
        if not taken:
            taken.append(manifest.number)
            VersionedTable(spark, self.path).refresh(days_frame(spark, [(30, D3)]), [D3])
        return plain(self, manifest)

    monkeypatch.setattr(VersionedTable, "_switch", late)
    assert held(versioned.refresh(days_frame(spark, [(20, D2)]), [D2])) == [(1, D1), (20, D2), (30, D3)]
    assert versioned.manifest().number == taken[0] + 1


def test_a_refresh_computes_its_frame_once(spark, versioned):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    versioned.refresh(days_frame(spark, [(20, D2), (30, D3)]).mapInPandas(seen, "v int, date date"), [D2, D3])
    assert rows.value == 2


def test_narrow_load_keeps_every_row(spark):
    columns = ", ".join(f"{c} {'date' if c == 'date' else 'string' if 'bucket' in c or c in ('source', 'inflow_outflow') else 'double'}" for c in serving.NARROW_COLUMNS)
    many = spark.range(1_200_000).select(*(F.lit(date(2024, 1, 30) if c == "date" else "x" if " string" in f"{c} string" and ("bucket" in c or c in ("source", "inflow_outflow")) else 1.0).alias(c) for c in serving.NARROW_COLUMNS))
    assert columns and serving.load_narrow(many, date(2024, 1, 31), 7).count() == 1_200_000


@pytest.fixture
def wide_days(spark, tmp_path):
    """A stored wide fact with rows on days 1, 3, 10 and 28 of the month."""
    days = [(date(2024, 1, d), n) for d in (3, 28, 1, 10) for n in range(2)]
    rows = spark.createDataFrame(days, "date date, first_chapter_bucket long")
    table = VersionedTable(spark, str(tmp_path / "wide"))
    table.replace(rows.select("date", "first_chapter_bucket", *(F.lit(0).alias(c) for c in C.WIDE_COLUMNS if c not in ("date", "first_chapter_bucket"))))
    return table


def order_of(df):
    return [(r.date.day, r.first_chapter_bucket) for r in df.collect()]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_first_without_a_shuffle(wide_days):
    as_of = date(2024, 1, 31)
    loaded = serving.load_newest_first(wide_days)
    assert order_of(loaded) == [(28, 0), (28, 1), (10, 0), (10, 1), (3, 0), (3, 1), (1, 0), (1, 1)]
    assert "Exchange" not in physical(loaded) and loaded.columns == list(C.WIDE_COLUMNS)
    assert order_of(serving.load_newest_first(wide_days, as_of, 21)) == [(28, 0), (28, 1), (10, 0), (10, 1)]
    assert order_of(serving.load_newest_first(wide_days, as_of, 1)) == []
    whole = serving.load_serving(wide_days.read(), as_of, 0)
    assert order_of(whole) == order_of(loaded)


def test_covering_load_reads_the_missing_days_only(wide_days):
    as_of = date(2024, 1, 31)
    loaded = serving.load_newest_first(wide_days, as_of, 5)
    asked = lambda first, days=5, frame=loaded: serving.load_covering(wide_days, as_of, (first, as_of), frame, days)
    more = asked(date(2024, 1, 3))
    assert order_of(more) == [(28, 0), (28, 1), (10, 0), (10, 1), (3, 0), (3, 1)]
    older = [f for f in more.inputFiles() if f not in loaded.inputFiles()]
    assert {f.split("date=")[1][:10] for f in older} == {"2024-01-10", "2024-01-03"}
    assert order_of(asked(date(2024, 1, 27))) == order_of(loaded) == order_of(serving.load_covering(wide_days, as_of, None, loaded, 5))
    # Two days that held nothing are short all the same; everything loaded is never short.
    assert order_of(asked(date(2024, 1, 10), 2, serving.load_newest_first(wide_days, as_of, 2))) == [(28, 0), (28, 1), (10, 0), (10, 1)]
    assert len(order_of(asked(date(2023, 1, 1), 0, serving.load_newest_first(wide_days)))) == 8


def test_sums_over_very_many_bins_of_one_key(spark):
    """A hot key with 120,000 bins: the running sums are made in groups of bins, and no group is larger than one."""
    bins = spark.range(0, 120_000, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") - 60_000).alias("b"), F.lit(1).alias("n"))
    got = joins._sums_before(bins, "k", "b", ["n"])
    assert got.where(F.col("_beforen") != F.col("b") + 60_000).count() == 0 and got.count() == 120_000
    assert bins.groupBy(F.floor(F.col("b") / joins.BINS_OF_A_GROUP)).count().agg(F.max("count")).first()[0] == joins.BINS_OF_A_GROUP
    windows = [line for line in physical(got).splitlines() if "Window [" in line]
    assert windows and all("_group" in line for line in windows)


def test_range_filter_takes_one_end_and_refuses_nonsense(spark):
    df = spark.createDataFrame([(date(2024, 1, n),) for n in (1, 2, 3)], "date date")
    assert filters.between_dates(df, None).count() == 3
    assert filters.between_dates(df, (None, "2024-01-02")).count() == 2 and filters.between_dates(df, (date(2024, 1, 3), None)).count() == 1
    for wrong in (("2024-13-01", None), (None, None), "2024-01-01", (1, 2, 3)):
        with pytest.raises((ValueError, TypeError)):
            filters.between_dates(df, wrong)


def test_window_sums_are_linear_and_right_for_one_hot_key(spark):
    """Many windows and events of one key in one bin, against a plain sum; rows of the plan stay under events plus ends."""
    r = random.Random(1)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    events = [("k", at(r.randrange(3000)), r.choice([None, 1, 2, 7])) for _ in range(300)] + [("idle", at(5), 3)]
    windows = [("k", at(a := r.randrange(3000)), at(a + r.randrange(-20, 900))) for _ in range(200)] + [("none", at(1), at(9)), ("idle", at(6), at(7)), ("k", None, at(3)), ("k", at(0), at(10**8))]
    e = spark.createDataFrame(events, "key string, at timestamp_ntz, v bigint")
    w = spark.createDataFrame(windows, "key string, a timestamp_ntz, b timestamp_ntz")
    want = sum(v or 0 for k, t, v in events for n, a, b in windows if k == n == "k" and a is not None and a <= t <= b)
    for bin_seconds in (100, 86400):
        got = joins.sum_in_windows(e, w, "key", "at", "a", "b", "v", "total", bin_seconds)
        assert [tuple(x) for x in got.collect()] == [("k", want)]
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_loaded_shape_of_frames_that_fail_it(spark):
    shape = lambda df: tuple(checks.loaded_shape(df).first())
    whole = spark.createDataFrame([(0,)], "x int").select(*(F.lit(0).alias(c) for c in C.WIDE_COLUMNS))
    assert shape(whole) == (1, 52, 0) and shape(whole.where("players > 0")) == (0, 52, 0)
    assert shape(whole.drop("players", "date").withColumn("surplus", F.lit(1))) == (1, 50, 2)
