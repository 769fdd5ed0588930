import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 1 and set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
