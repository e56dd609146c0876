"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans.queries import QUERIES
from netloom.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return str(value.normalize())
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    twin = duck.sql(entry.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    places = [twin.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in places) for r in twin.fetchall())
    assert found


def test_entry(spark):
    assert entry.entry(spark).count() == 3
