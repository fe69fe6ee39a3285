"""Queries that SQL can state in full, against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from barsignals.llm.oracle import ORACLE
from barsignals.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    result = con.execute(ORACLE[name])
    columns = sorted(d[0] for d in result.description)
    want = Counter(tuple(sorted(zip((d[0] for d in result.description), r))) for r in result.fetchall())
    df = QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == columns
    assert Counter(tuple(sorted(r.asDict().items())) for r in df.collect()) == want
