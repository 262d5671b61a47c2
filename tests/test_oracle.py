"""Catalogue queries against their DuckDB oracles on the smallest fixture."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from fleetcraft.sources.tables import RAW_TABLES

SF = "/root/testdata/sf0.001"
DRIVER = sorted(name for name in entry.oracle_sql() if not name.startswith("op") or not name[2:3].isdigit())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        return str(v)[:19]
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", DRIVER)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = _norm(sdf.select(*cols).collect())
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    exp = _norm([tuple(r[i] for i in idx) for r in res.fetchall()])
    assert len(got) == len(exp)
    assert got == exp


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
