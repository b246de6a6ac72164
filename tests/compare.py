"""Order-free comparison of a Spark result with the checking SQL run in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
}


def differences(df, connection, sql: str) -> list[str]:
    """What differs: columns, types, rows. Empty when the results agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    wanted = _bag(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    out = []
    for field in df.schema.fields:
        ours = _KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if ours != kinds[field.name]:
            out.append(f"type of {field.name}: {ours} != {kinds[field.name]}")
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if got != wanted:
        missing, extra = wanted - got, got - wanted
        out.append(
            f"rows {sum(got.values())} != {sum(wanted.values())}; missing {sum(missing.values())}"
            f" e.g. {list(missing)[:2]}; extra {sum(extra.values())} e.g. {list(extra)[:2]}"
        )
    return out
