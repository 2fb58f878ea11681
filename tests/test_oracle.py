"""Registered queries of the core against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from knowlark.plans import registry
from tests.conftest import SF


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert len(df.columns) > 0
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted((tuple(plain(r[df.columns.index(c)]) for c in names) for r in rows), key=repr)
    other = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert mine == other
