"""Every core query that has SQL equals it on the small tables."""

import glob
import os

import duckdb
import pytest

from paceline.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(0.0 if v[i] == 0 else v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = rows(df.columns, df.collect())
    r = duck.execute(SQL[name])
    want = rows([d[0] for d in r.description], r.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == pytest.approx(b, abs=1e-3)
