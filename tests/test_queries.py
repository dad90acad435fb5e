"""Every registered query of the reference's own operators against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest
from weftline.plans import analytics, learned, operations, preparation, ranking, search  # noqa: F401
from weftline.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    return round(float(v), 5) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    at = [found.columns.index(c) for c in order]
    mine = sorted([tuple(plain(r[c]) for c in order) for r in rows], key=str)
    theirs = sorted([tuple(plain(r[i]) for i in at) for r in found.fetchall()], key=str)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
