"""Schemas of the four input tables, and the check done on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("distinct_id", T.StringType()),
        T.StructField("mp_event_name", T.StringType()),
        T.StructField("res_timestamp", T.TimestampType()),
        T.StructField("item_id_1_name", T.StringType()),
        T.StructField("item_quantity_1", T.DoubleType()),
        T.StructField("delta_credits", T.DoubleType()),
        T.StructField("bubble_cost", T.DoubleType()),
        T.StructField("number_of_events", T.LongType()),
        T.StructField("mode_status", T.LongType()),
        T.StructField("mp_country_code", T.StringType()),
    ]
)
PLAYER_DAYS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("distinct_id", T.StringType()),
        T.StructField("first_chapter", T.LongType()),
        T.StructField("last_credit_balance", T.DoubleType()),
        T.StructField("last_app_version", T.DoubleType()),
        T.StructField("total_purchase_revenue", T.DoubleType()),
    ]
)
PLAYERS = T.StructType(
    [
        T.StructField("distinct_id", T.StringType()),
        T.StructField("first_country", T.StringType()),
        T.StructField("ltv_purchases", T.LongType()),
    ]
)
FRAUDSTERS = T.StructType([T.StructField("distinct_id", T.StringType())])


def _kind(data_type: T.DataType) -> str:
    """Types that may stand for each other share a kind: any number, any timestamp."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return data_type.simpleString()


def check_schema(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """The declared columns of `df`; raises if one is missing or of another kind."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        if field.name not in have:
            problems.append(f"{field.name} is missing")
        elif _kind(have[field.name]) != _kind(field.dataType):
            problems.append(f"{field.name} is {have[field.name].simpleString()}, not {field.dataType.simpleString()}")
    if problems:
        raise ValueError(f"table {table}: " + "; ".join(problems))
    return df.select(*schema.fieldNames())
