"""Every query runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from granary import queries as retrieval

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(retrieval.QUERIES))
def test_query(spark, duck, name):
    got = retrieval.QUERIES[name](spark, DATA).toPandas()
    if name in retrieval.ORACLE:
        want = duck.execute(retrieval.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        integral = lambda f: f.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" or str(c.dtype).startswith("Int") else c)
        assert canonical(integral(got)) == canonical(integral(want))
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
