"""Every query over the driver tables gives what its DuckDB SQL gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from weftline.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def shown(rows):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    want = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert shown(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == shown(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DIR):
        assert entry.entry(spark).count() > 0
