"""Every registered query against its SQL twin, value by value, on the smallest tables."""
import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"

import __spark_entry__ as entry_point
from firmground.plans import load
from tools.compare import rows_of, views

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return views(duckdb.connect(), DATA)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, [tuple(r) for r in rows]) == rows_of(names, cur.fetchall())
