"""The queries that SQL can say, against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from arbolex.llm.queries import ORACLE_SQL, PARTS, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = (QUERIES | PARTS)[name](spark, DATA), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert a == b
