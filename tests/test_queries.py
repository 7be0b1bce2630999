"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from folioquarry.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.collect())
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows == sorted(repr(tuple(plain(r[columns.index(c)]) for c in df.columns)) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
