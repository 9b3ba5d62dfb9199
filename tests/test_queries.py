"""Every registered query of the engine runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry  # registers the queries
from recallforge.plans.registry import ORACLES, QUERIES


def rows(columns, found):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in found), sorted(columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    o = con.execute(ORACLES[name])
    names = [d[0] for d in o.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in o.fetchall()]
    assert rows(cols, got) == rows(names, want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
