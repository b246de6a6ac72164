"""The four input tables: scans of stored tables, and views that derive them from the benchmark tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbledger import config as C
from ebbledger.operators.filters import closed_open_window, open_window
from ebbledger.sources import schemas

# The benchmark events end on 2024-01-30; the day after stands for today.
AS_OF = date(2024, 1, 31)


@dataclass(frozen=True)
class Inputs:
    events: DataFrame
    player_days: DataFrame
    players: DataFrame
    fraudsters: DataFrame


# -- stored tables ----------------------------------------------------------


def scan_events(source: DataFrame, as_of=None, days: int | None = None, until_today: bool = True) -> DataFrame:
    """Events of the last `days` days. The filter sits on the partition column, so whole days are skipped.

    `until_today` leaves out the reference date and later; without it the window is open at the end.
    """
    events = schemas.check_schema(source, schemas.EVENTS, "events")
    if days is None:
        return events
    window = closed_open_window if until_today else open_window
    return events.where(window("date", as_of, days))


def scan_player_days(source: DataFrame) -> DataFrame:
    return schemas.check_schema(source, schemas.PLAYER_DAYS, "player_days")


def scan_players(source: DataFrame) -> DataFrame:
    return schemas.check_schema(source, schemas.PLAYERS, "players")


def scan_fraudsters(source: DataFrame) -> DataFrame:
    return schemas.check_schema(source, schemas.FRAUDSTERS, "fraudsters")


def stored_inputs(spark: SparkSession, events: str, player_days: str, players: str, fraudsters: str) -> Inputs:
    """The four tables from Parquet paths; events and player days are best stored partitioned by date."""
    read = spark.read.parquet
    return Inputs(
        scan_events(read(events)),
        scan_player_days(read(player_days)),
        scan_players(read(players)),
        scan_fraudsters(read(fraudsters)),
    )


# -- benchmark tables -------------------------------------------------------


_LISTED = "array(" + ", ".join(f"'{s}'" for s in C.INFLOW_SOURCES) + ")"
_LISTED_SOURCE = f"element_at({_LISTED}, CAST(event_id % {len(C.INFLOW_SOURCES)} + 1 AS INT))"


def derive_events(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "CAST(ts AS DATE) AS date",
        "CAST(user_id AS STRING) AS distinct_id",
        "event_id",
        f"""CASE WHEN event_type = 'click' THEN {_LISTED_SOURCE}
                 WHEN event_type = 'signup' THEN if(event_id % 5 = 0, 'rewards_daily', {_LISTED_SOURCE})
                 WHEN event_type = 'purchase' THEN '{C.GENERATION}'
                 WHEN event_type = 'view' THEN '{C.BUBBLE}'
                 ELSE event_type END AS mp_event_name""",
        "if(event_id % 97 = 0, NULL, ts) AS res_timestamp",
        """CASE WHEN event_id % 10 = 0 THEN 'gems' WHEN event_id % 41 = 0 THEN NULL
                ELSE 'Credits_Pack' END AS item_id_1_name""",
        "if(event_id % 50 = 1, NULL, CAST(floor(value) AS BIGINT)) AS item_quantity_1",
        "if(event_type = 'purchase' AND event_id % 13 <> 0, -CAST(floor(value) AS BIGINT), NULL) AS delta_credits",
        "if(event_type = 'view', CAST(floor(value) AS BIGINT), NULL) AS bubble_cost",
        "if(event_type = 'purchase' AND event_id % 3 = 0, 1 + event_id % 4, NULL) AS number_of_events",
        "if(event_id % 31 = 0, NULL, event_id % 4) AS mode_status",
        """CASE user_id % 12 WHEN 0 THEN 'UA' WHEN 1 THEN 'IL' WHEN 2 THEN 'AM' WHEN 3 THEN NULL WHEN 4 THEN 'GB'
                ELSE 'US' END AS mp_country_code""",
    )


def derive_player_days(raw: DataFrame) -> DataFrame:
    """One row per player and day; days with nothing but errors have none."""
    spent = "if(event_type = 'purchase' AND value > 60, CAST(floor(value) AS BIGINT), 0)"
    return (
        raw.where("event_type <> 'error'")
        .groupBy(F.expr("CAST(ts AS DATE) AS date"), F.expr("CAST(user_id AS STRING) AS distinct_id"))
        .agg(
            F.expr("min_by(CAST(get_json_object(props, '$.k') AS BIGINT), event_id) AS first_chapter"),
            F.expr("CAST(sum(CAST(floor(value) AS BIGINT)) * 10 AS DOUBLE) AS last_credit_balance"),
            F.expr(
                """if(max(event_id) % 17 = 0, NULL, CAST(35 + max(event_id) % 5 AS DOUBLE) / 100)
                   AS last_app_version"""
            ),
            F.expr(f"CAST(sum({spent}) AS DOUBLE) AS total_purchase_revenue"),
        )
    )


def derive_players(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per player, with some players left without a row and some without a country on purpose."""
    bought = (
        orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    nation = F.col("c_nationkey") % 8
    return (
        customer.where(F.col("c_custkey") % 29 != 0)
        .join(bought, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("distinct_id"),
            F.when(nation <= 2, "US")
            .when(nation == 3, "GB")
            .when(nation == 4, "DE")
            .when(nation == 5, "UA")
            .when(nation == 6, "FR")
            .alias("first_country"),
            F.coalesce("n", F.lit(0)).alias("ltv_purchases"),
        )
    )


def derive_fraudsters(customer: DataFrame) -> DataFrame:
    return customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").cast("string").alias("distinct_id"))


def benchmark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The four inputs derived from the benchmark tables of one scale folder."""
    raw, customer, orders = (benchmark_table(spark, sf_dir, t) for t in ("events", "customer", "orders"))
    return Inputs(
        derive_events(raw),
        derive_player_days(raw),
        derive_players(customer, orders),
        derive_fraudsters(customer),
    )
