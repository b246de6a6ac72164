"""Every catalogued query against its SQL in DuckDB, on the whole tables."""

import pytest
from compare import differences, open_tables
from conftest import DATA

import __spark_entry__ as entry_points
from ebbledger.plans.catalog import CATALOG as QUERIES
from ebbledger.plans.oracle import ORACLE as SQL

SF_DIR = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = open_tables(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= entry_points.queries().keys() and SQL.keys() <= entry_points.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, SQL[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() == 14
