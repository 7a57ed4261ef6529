"""Every registered query with a SQL twin against DuckDB on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
from __spark_entry__ import entry, oracle_sql, queries
from queries import ORACLE

SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), cols) == ""


def test_entry_groups(spark):
    groups = {}
    for r in entry(spark).collect():
        groups.setdefault(r.group_id, set()).add(r.source_id)
    assert sorted(map(sorted, groups.values())) == [[0, 3], [1, 9], [2, 5], [4, 6], [7, 8]]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
