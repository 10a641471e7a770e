"""Every registered query against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from brindle.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted([tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()], key=repr)
