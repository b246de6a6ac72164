"""Hand-written inputs: events and tables with only the columns that matter set."""

from __future__ import annotations

from datetime import date, datetime

from ebbledger.sources import schemas
from ebbledger.sources.inputs import Inputs

DAY = date(2024, 1, 30)
TODAY = date(2024, 1, 31)

_EVENT = {
    "date": DAY,
    "distinct_id": "p1",
    "mp_event_name": "rewards_race",
    "res_timestamp": datetime(2024, 1, 30, 12),
    "item_id_1_name": "Credits",
    "item_quantity_1": None,
    "delta_credits": None,
    "bubble_cost": None,
    "number_of_events": None,
    "mode_status": None,
    "mp_country_code": "US",
}
_DAY = {
    "date": DAY,
    "distinct_id": "p1",
    "first_chapter": 5,
    "last_credit_balance": 50.0,
    "last_app_version": 1.0,
    "total_purchase_revenue": 0.0,
}
_PLAYER = {"distinct_id": "p1", "first_country": "US", "ltv_purchases": 0}


def reward(source, quantity, **more):
    return {"mp_event_name": source, "item_quantity_1": None if quantity is None else float(quantity), **more}


def generation(delta, mode=0, number=None, **more):
    value = None if delta is None else float(delta)
    return {"mp_event_name": "generation", "delta_credits": value, "mode_status": mode, "number_of_events": number, **more}


def bubble(cost, **more):
    return {"mp_event_name": "click_bubble_purchase", "bubble_cost": float(cost), **more}


def _frame(spark, defaults, rows, schema):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple({**defaults, **r}[n] for n in names) for r in rows], schema)


def events(spark, rows):
    return _frame(spark, _EVENT, rows, schemas.EVENTS)


def player_days(spark, rows):
    return _frame(spark, _DAY, rows, schemas.PLAYER_DAYS)


def players(spark, rows):
    return _frame(spark, _PLAYER, rows, schemas.PLAYERS)


def fraudsters(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], schemas.FRAUDSTERS)


def inputs(spark, event_rows, day_rows=({},), player_rows=({},), fraud_ids=("nobody",)):
    return Inputs(
        events(spark, event_rows),
        player_days(spark, day_rows),
        players(spark, player_rows),
        fraudsters(spark, fraud_ids),
    )
