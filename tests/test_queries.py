"""Every registered query outside the training-text operators, against its SQL in an independent engine."""

import os

import duckdb
import pandas as pd
import pytest

from outlake.plans import registry
from tests.conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value != value:
        return "null"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    out = QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in SQL:
        return
    want = oracle.sql(SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    order = [out.columns.index(c) for c in sorted(out.columns)]
    theirs = [want.columns.index(c) for c in sorted(want.columns)]
    got = sorted(tuple(plain(r[i]) for i in order) for r in rows)
    assert got == sorted(tuple(plain(r[i]) for i in theirs) for r in want.fetchall())
