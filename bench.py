"""Times the fact builds and the views; prints one JSON line.

BENCH_SF_DIR names the scale folder, BENCH_CPUS the threads. Each query runs
once to warm up, then BENCH_RUNS times; its median counts. `from_events`
queries start at the raw tables, `stored` ones at a wide fact written before.
Every timing carries its rows, the bytes it shuffled, and a check: an
order-free sum over the result that is the same in every run.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbledger.plans import facts, views
from ebbledger.sources import sinks
from ebbledger.sources.inputs import AS_OF, Inputs, benchmark_inputs
from ebbledger.sources.serving import normalise

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ebbledger-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="ebbledger-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffled(spark: SparkSession) -> int:
    """Bytes written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def check(df: DataFrame) -> dict:
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    total = sum((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in numbers), F.lit(0.0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 2).alias("sum")).first()
    return {"rows": row["n"], "sum": row["sum"]}


def multiplied(spark: SparkSession, copies: int, players: bool = False) -> Inputs:
    """The inputs with every event `copies` times, events and player-days stored: so that data is timed, not planning.

    With players, each copy is of players of its own, so that no map-side sum takes the copies together.
    """
    given = benchmark_inputs(spark, SF_DIR)
    tables = {"events": given.events, "player-days": given.player_days, "players": given.players, "fraudsters": given.fraudsters}
    paths = {}
    for name, rows in tables.items():
        if players or name == "events":
            rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
            rows = rows.withColumn("distinct_id", F.concat("distinct_id", F.lit("-"), F.col("_copy").cast("string")) if players else F.col("distinct_id")).drop("_copy")
        paths[name] = sinks.new_path(spark, name)
        rows.write.parquet(paths[name])
    return Inputs(*(spark.read.parquet(path) for path in paths.values()))


def main() -> None:
    spark = session()
    stored = sinks.replace_table(facts.build_wide(benchmark_inputs(spark, SF_DIR), AS_OF), sinks.new_path(spark, "wide"))
    given = lambda: benchmark_inputs(spark, SF_DIR)
    many, crowd = multiplied(spark, 40), multiplied(spark, 40, players=True)
    fresh = lambda: normalise(facts.build_wide(given(), AS_OF))
    kept = lambda: normalise(stored)
    queries = {
        "wide_build": lambda: facts.build_wide(given(), AS_OF),
        "wide_compat_build": lambda: facts.build_wide(given(), AS_OF, grain="compat"),
        "long_build": lambda: facts.build_long(given(), AS_OF),
        "narrow_build": lambda: facts.build_narrow(given(), AS_OF),
        "wide_build_40x": lambda: facts.build_wide(many, AS_OF),
        "long_build_40x": lambda: facts.build_long(many, AS_OF),
        "wide_build_40x_players": lambda: facts.build_wide(crowd, AS_OF),
        "long_build_40x_players": lambda: facts.build_long(crowd, AS_OF),
        "v1_from_events": lambda: views.view_consumption_trend(fresh()),
        "v2_from_events": lambda: views.view_credit_components(fresh()),
        "v3_from_events": lambda: views.view_free_vs_paid(fresh()),
        "v4_from_events": lambda: views.view_free_share_by_source(fresh()),
        "v5_from_events": lambda: views.view_rtp_by_source(fresh()),
        "v6_from_events": lambda: views.dashboard_table(fresh()),
        "v1_stored": lambda: views.view_consumption_trend(kept()),
        "v1_stored_by_chapter": lambda: views.view_consumption_trend(kept(), "first_chapter_bucket"),
        "v5_stored": lambda: views.view_rtp_by_source(kept()),
        "v6_stored": lambda: views.dashboard_table(kept()),
    }
    seconds, details = {}, {}
    for name, make in queries.items():
        result = check(make())
        before = shuffled(spark)
        times = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            run(make())
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times), 4)
        details[name] = {**result, "shuffle_bytes": (shuffled(spark) - before) // RUNS}
        if check(make()) != result:
            raise SystemExit(f"{name}: the result changed between runs")
    print(
        json.dumps(
            {
                "metric": "credit facts and views, sum of median seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "details": details,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
