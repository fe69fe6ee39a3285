"""Every named query against its DuckDB oracle SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from barsignals.plans.oracle import oracle_sql
from barsignals.plans.queries import QUERIES
from paths import SF_SMALL

sys_tables = ["region", "nation", "supplier", "orders", "lineitem", "events"]
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in sys_tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLE[name])
    want = _bag([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "sma_buy" in df.columns
