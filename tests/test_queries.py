"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from orrery import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


def _same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_same, v))
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    names = sorted(frame.columns)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(_same(r[columns.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    got = sorted((tuple(_same(r[n]) for n in names) for r in frame.collect()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs_and_repeats(spark, small, name):
    first = sorted(map(repr, QUERIES[name](spark, small).collect()))
    assert first and first == sorted(map(repr, QUERIES[name](spark, small).collect()))
