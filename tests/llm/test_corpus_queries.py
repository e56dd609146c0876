"""The corpus queries against their SQL twins in DuckDB, on a small copy of the tables."""

import duckdb
import pytest

from netloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    table = "pages" if "html" in name else "documents"
    assert len(rows) >= (1 if "negatives" in name else spark.read.parquet(f"{FOLDER}/{table}.parquet").count())
    if name in ORACLES:
        duck = duckdb.connect()
        for table in ("documents", "benchmark", "embeddings"):
            duck.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        twin = duck.sql(ORACLES[name])
        assert sorted(twin.columns) == sorted(frame.columns)
        columns = sorted(frame.columns)
        places = [twin.columns.index(c) for c in columns]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(repr(tuple(r[i] for i in places)) for r in twin.fetchall())


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
