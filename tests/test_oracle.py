"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sharelens.jobs.queries import ORACLE, QUERIES
from sharelens.jobs.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, rows_of, name):
    found = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(found.columns)
    columns = sorted(names)
    wanted = [dict(zip(names, r)) for r in cur.fetchall()]
    assert rows_of([r.asDict() for r in found.collect()], columns) == rows_of(wanted, columns)
