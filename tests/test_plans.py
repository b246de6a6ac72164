"""What the planner makes of the facts: scans, joins, shuffles."""

import re
from pathlib import Path

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ebbledger.operators import calendar, filters, joins
from ebbledger.plans.catalog import CATALOG
from ebbledger.plans import views
from ebbledger.plans.facts import build_long, build_narrow, build_wide
from ebbledger.sources import sinks
from ebbledger.sources.inputs import AS_OF, benchmark_inputs, scan_events, stored_inputs
from ebbledger.sources.serving import normalise, select_segments


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The inputs as they lie on a cluster: events and player days partitioned by date."""
    root = str(tmp_path_factory.mktemp("stored"))
    derived = benchmark_inputs(spark, f"{DATA}/sf0.01")
    derived.events.drop("event_id").write.partitionBy("date").parquet(f"{root}/events")
    derived.player_days.write.partitionBy("date").parquet(f"{root}/player_days")
    derived.players.write.parquet(f"{root}/players")
    derived.fraudsters.write.parquet(f"{root}/fraudsters")
    return stored_inputs(spark, *[f"{root}/{t}" for t in ("events", "player_days", "players", "fraudsters")])


@pytest.fixture
def large(spark):
    """As if no side were small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def scans_of(text: str, column: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and column in line]


def shuffles(text: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\(.*?\)), ENSURE", text)


def test_wide_reads_events_once_with_the_window_on_partitions(stored):
    text = plan(build_wide(stored, AS_OF))
    (scan,) = scans_of(text, "mp_event_name")
    assert "date >= 2024-01-17" in scan and "date < 2024-01-31" in scan
    assert "PartitionFilters: [isnotnull(date)" in scan
    assert "IsNotNull(res_timestamp)" in scan
    days = scans_of(text, "last_credit_balance")
    assert days and all("date >= 2024-01-17" in d for d in days)


def test_player_join_becomes_inner_and_nothing_is_python_or_crossed(stored, large):
    for text in (plan(build_wide(stored, AS_OF)), plan(joins.with_player(stored.player_days, stored.players))):
        assert "LeftOuter" not in text and "Inner" in text
        assert not re.search(r"Python|Pandas|Arrow|Cartesian|NestedLoop", text)


def test_wide_shuffles_events_after_a_partial_sum(stored, large):
    text = plan(build_wide(stored, AS_OF))
    keys = shuffles(text)
    assert sum(k.startswith("hashpartitioning(distinct_id, date,") for k in keys) == 2  # events and player-days, each once
    assert sum("first_chapter_bucket" in k for k in keys) == 1
    assert not any("source" in k for k in keys)
    assert any("partial_sum(CASE WHEN (source" in text[m.start() :].split("\n", 2)[1] for m in re.finditer(r"Exchange hashpartitioning\(distinct_id, date", text))


def test_exclusion_is_not_broadcast_when_large(stored, large):
    text = plan(joins.not_in(stored.events, stored.fraudsters))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_small_exclusion_reaches_the_event_scan_in_the_long_fact(stored):
    text = plan(build_long(stored, AS_OF))
    assert "BroadcastHashJoin [distinct_id], [distinct_id], LeftAnti" in text
    assert text.index("partial_sum(_value)") < text.index("LeftAnti") < text.index("mp_event_name,")


def test_long_window_needs_no_shuffle_of_its_own(stored, large):
    text = plan(build_long(stored, AS_OF))
    window = text.index("Window [")
    join = text.index("LeftOuter")
    assert window < join and "Exchange" not in text[window:join] and "Sort [" not in text[window:join]


def test_hot_player_in_an_event_join_is_split(spark, large):
    """A third of the events on one player: adaptive execution splits that partition, and no row is lost."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("distinct_id"),
            F.md5(F.col("id").cast("string")).alias("payload"),
        )
        path = sinks.new_path(spark, "players")
        rows.select("distinct_id").distinct().withColumn("first_country", F.lit("US")).write.parquet(path)
        players = spark.read.parquet(path)
        joined = joins.with_player(rows, players)
        assert joined.agg(F.count(F.lit(1))).first()[0] == 60000
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["j2_events_with_player", "j5_events_not_in_list"])
def test_event_joins_can_be_split(spark, large, name):
    """Adaptive execution splits a hot key only where both sides of the join are shuffles of their own."""
    text = plan(CATALOG[name](spark, f"{DATA}/sf0.001"))
    lines = text.splitlines()
    joined = next(n for n, line in enumerate(lines) if "SortMergeJoin [" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    sides = [n for n in range(joined + 1, len(lines)) if "Sort [" in lines[n] and depth(lines[n]) == depth(lines[joined]) + 3]
    assert len(sides) == 2 and all("ENSURE_REQUIREMENTS" in lines[n + 1] for n in sides)


def files_read(df, column) -> list[int]:
    """Number of files that each scan with the column read, once the frame has run."""
    df.collect()
    root, found = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name == "FileSourceScanExec" and column in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for n in range(children.size()):
            visit(children.apply(n))

    visit(root)
    return found


def test_window_skips_the_folders_of_other_days(spark, stored):
    whole = len(stored.events.inputFiles())
    recent = scan_events(stored.events, AS_OF, 7)
    (scan,) = scans_of(plan(recent), "mp_event_name")
    assert "PartitionFilters: [isnotnull(date), (date >= 2024-01-24), (date < 2024-01-31)]" in scan
    days = {f.split("date=")[1][:10] for f in stored.events.inputFiles()}
    one_a_day = whole // len(days)
    assert files_read(recent, "mp_event_name") == [7 * one_a_day] and whole == len(days) * one_a_day


def test_days_of_another_table_skip_folders_at_run_time(spark, stored):
    """The other table says which days while the query runs; the scan then leaves out the files of all others."""
    few = stored.player_days.where("total_purchase_revenue > 300")
    n, whole = few.select("date").distinct().count(), len({f.split("date=")[1][:10] for f in stored.events.inputFiles()})
    assert 0 < n < whole
    kept = filters.on_days(stored.events, few)
    (scan,) = scans_of(plan(kept), "mp_event_name")
    assert "dynamicpruning" in scan.split("PushedFilters")[0]
    assert files_read(kept, "mp_event_name") == [n * len(stored.events.inputFiles()) // whole]
    assert kept.select("date").distinct().count() == n


def test_views_prune_the_pivot(stored):
    from ebbledger.operators.metrics import daily_sums, kpis
    from ebbledger.sources.serving import normalise

    text = plan(kpis(daily_sums(normalise(build_wide(stored, AS_OF)), columns=("total_inflow", "total_free_inflow", "total_paid_inflow", "total_outflow"))))
    assert "_cnt" not in text
    (scan,) = scans_of(text, "mp_event_name")
    assert "number_of_events" not in scan and "mode_status" not in scan


def test_exclusion_list_has_one_aggregate(stored):
    """The NULL rules read one aggregate of the list; Spark runs equal subqueries once."""
    text = joins.null_rules(stored.events, stored.fraudsters)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = {re.sub(r"^[ :+-]*", "", re.sub(r"#\d+L?", "", line)) for line in text.splitlines() if "Aggregate [" in line}
    assert len(aggregates) == 1 and "count(distinct_id)" in next(iter(aggregates))


def test_narrow_needs_no_distinct(stored):
    assert "count(distinct " not in plan(build_narrow(stored, AS_OF))


RANGES = (None, ("2024-01-10", "2024-02-02"))


def every_view(served, dimension, over):
    each = (views.view_consumption_trend, views.view_credit_components, views.view_free_vs_paid, views.view_free_share_by_source, views.view_rtp_by_source)
    table = views.dashboard_table(served, {"is_us_player": [1]}, dimension, over)
    return [*(view(served, dimension, over) for view in each), *views.dashboard(served, None, dimension, over).values(), table]


@pytest.mark.parametrize("dimension", [None, "last_balance_bucket"])
def test_views_start_no_job_and_scan_once(spark, tmp_path, dimension):
    """One scan and no join in the plan as it is first made, so that nothing depends on a reuse found later."""
    path = str(tmp_path / "wide")
    build_wide(benchmark_inputs(spark, f"{DATA}/sf0.001"), AS_OF).write.partitionBy("date").parquet(path)
    table = spark.read.parquet(path)
    before = sorted(p.name for p in tmp_path.iterdir()), set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    spark.sparkContext.setJobGroup("views", "definition")
    made = [view for over in RANGES for view in every_view(normalise(table), dimension, over)]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("views")
    assert before == (sorted(p.name for p in tmp_path.iterdir()), set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir()))
    for view in made:
        initial = plan(view)
        assert initial.count("FileScan parquet") == 1 and "Join" not in initial and "Subquery" not in initial, initial
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_dashboard_from_events_reads_each_table_once(stored):
    shown = views.dashboard_table(normalise(build_wide(stored, AS_OF)), None, "paid_ever_flag")
    text = plan(shown)
    assert len(text) < 150_000 and text.count("FileScan parquet") == plan(build_wide(stored, AS_OF)).count("FileScan parquet")


def test_no_task_of_a_split_view_holds_all_values(spark):
    """Values are dealt to parts; each part has its values and what all values have in common."""
    rows = spark.range(0, 3000).selectExpr("date'2024-01-01' + CAST(id % 3 AS INT) AS date", "CAST(id AS STRING) AS v", "1D AS x")
    parts = calendar.filled(rows, "v", "data").groupBy(F.pmod(F.hash("v"), F.lit(calendar.PARTS))).count().collect()
    assert sum(r[1] for r in parts) == 3000 * 3 and max(r[1] for r in parts) < 2 * 9000 / calendar.PARTS


def test_segments_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    build_wide(benchmark_inputs(spark, f"{DATA}/sf0.001"), AS_OF).write.partitionBy("date").parquet(path)
    table = spark.read.parquet(path)
    chosen = {"first_chapter_bucket": ["11-20", "None"], "is_us_player": [1], "paid_ever_flag": [0]}
    text = plan(normalise(select_segments(table, chosen)))
    pushed = text[text.index("PushedFilters: [") :]
    assert "In(first_chapter_bucket, [11-20,None])" in pushed.split("ReadSchema")[0] and "is_us_player" in pushed.split("ReadSchema")[0]
    after = normalise(table).where("first_chapter_bucket in ('11-20', 'None') and is_us_player = 1 and paid_ever_flag = 0")
    assert normalise(select_segments(table, chosen)).exceptAll(after).count() == 0 == after.exceptAll(normalise(select_segments(table, chosen))).count()


def test_gap_fill_queries_still_add_rows(spark):
    """The queries of the gap fill read the whole tables, and days or pairs are missing there."""
    for name in ("g1_missing_days", "g2_missing_days_by_segment", "g3_missing_pairs", "g4_source_grid", "g4_source_grid_by_segment"):
        rows = CATALOG[name](spark, f"{DATA}/sf0.01")
        measures = [c for c, t in rows.dtypes if t in ("double", "bigint", "decimal(38,0)")]
        assert rows.where(" and ".join(f"`{c}` = 0" for c in measures)).count() > 0, name
