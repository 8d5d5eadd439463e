"""Queries of the training-data operators against their SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from paceline.llm import bpe, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR) or not os.path.exists(bpe.DEFAULT_VOCAB), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, r = queries.QUERIES[name](spark, DIR), c.execute(queries.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(x) for x in df.select(*columns).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def test_updated_sample_is_the_sample(spark):
    assert sorted(queries.p1_updated(spark, DIR).collect()) == sorted(queries.p1_sample(spark, DIR).collect())
