"""The corpus queries that SQL can express, against it."""

import glob
import os

import duckdb
import pytest

from factloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_equals_its_sql(spark, small, name):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(row[names.index(k)] for k in cols) for row in found.fetchall())
    assert sorted(tuple(r[k] for k in cols) for r in df.collect()) == want and want


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
