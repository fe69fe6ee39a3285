"""Stored bars: years that a range skips, corrected bars, blocks that need no exchange, runs from a state."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from barsignals import enrich, in_range, load_bars
from barsignals.operators.indicators import Params
from barsignals.plans import bindings as B
from barsignals.plans.resume import advance, resume, series_state
from barsignals.schema import SchemaError
from barsignals.sources.bars import latest_revisions
from barsignals.sources.blocks import enrich_blocks, stored_layout, write_blocks
from barsignals.sources.sinks import write_enriched
from barsignals.staging import staged
from golden import BARS_DDL, golden_bars
from paths import SF_SMALL


def executed(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def daily(spark):
    return B.lineitem_bars(spark, SF_SMALL, "day").cache()


def same(a, b, drop=()):
    """Equal rows, doubles to 1e-9."""
    keep = [c for c in a.columns if c not in drop]
    rows = lambda df: sorted((tuple(r) for r in df.select(*keep).collect()), key=lambda r: (str(r[0]), str(r[1])))
    x, y = rows(a), rows(b)
    assert len(x) == len(y) > 0
    for p, q in zip(x, y):
        for c, u, v in zip(keep, p, q):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= 1e-9 * max(1.0, abs(u)), (p[:2], c, u, v)
            else:
                assert u == v, (p[:2], c, u, v)


def test_a_range_selects_the_stored_years(spark, daily, tmp_path):
    path = str(tmp_path / "bars")
    write_enriched(daily, path)
    got = load_bars(spark, path, start="1997-03-01", end="1998-02-01")
    plan = executed(got)
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "bar_year >= 1997" in pruned and "bar_year <= 1998" in pruned
    opened = {r[0].split("bar_year=")[1][:4] for r in got.select(F.input_file_name()).distinct().collect()}
    assert opened == {"1997", "1998"}
    same(got.drop("bar_year"), in_range(daily, "1997-03-01", "1998-02-01"))
    # an end on New Year's Day opens one year more than it needs, no row more
    edge = load_bars(spark, path, start=dt.date(1997, 1, 1), end=dt.date(1998, 1, 1))
    assert {r[0] for r in edge.select(F.year("bar_date")).distinct().collect()} == {1997}
    one_sided = load_bars(spark, path, start="2001-01-01")
    assert one_sided.count() == daily.filter("bar_date >= DATE'2001-01-01'").count()


def test_duplicates_are_rejected(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    bars.union(bars.limit(1)).write.parquet(path)
    with pytest.raises(SchemaError, match="duplicate"):
        load_bars(spark, path, check_unique=True)
    with pytest.raises(Exception, match="duplicate"):
        enrich(load_bars(spark, path)).collect()


def test_latest_revision_wins(spark):
    day = dt.date(2024, 1, 1)
    bar = lambda s, d, c, v: (s, d, c, c, c, c, c, 1.0, v)
    ddl = BARS_DDL + ", revision int"
    rows = [bar("A", day, 1.0, 1), bar("A", day, 2.0, 3), bar("A", day, 9.0, 2), bar("B", day, 5.0, None),
            bar("C", day, 4.0, 7), bar("C", day, 6.0, 7)]
    got = {(r["symbol"], r["close"], r["revision"]) for r in latest_revisions(spark.createDataFrame(rows, ddl), "revision").collect()}
    assert got == {("A", 2.0, 3), ("B", 5.0, None), ("C", 6.0, 7)}
    with pytest.raises(Exception, match="no revision"):
        latest_revisions(spark.createDataFrame(rows + [bar("B", day, 5.0, 1)], ddl), "revision").collect()
    plan = executed(latest_revisions(spark.createDataFrame(rows, ddl), "revision"))
    assert len(re.findall(r"Exchange ", plan)) == 1


def test_blocks_are_enriched_without_moving_bars(spark, daily, tmp_path):
    write_blocks(daily, "bars_in_blocks", 4, block_rows=345, path=str(tmp_path / "blocks"))
    out = enrich_blocks(spark, "bars_in_blocks")
    plan = executed(out)
    # only the summary of one row per block is exchanged
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all("_blk" not in k and "_seg" not in k for k in keys)
    same(enrich(daily), out)
    assert stored_layout(spark, "bars_in_blocks").block == 345
    with pytest.raises(SchemaError, match="other spans"):
        enrich_blocks(spark, "bars_in_blocks", Params(ema_slow=100))
    same(enrich(daily, Params(sma_slow=9), include=("sma",)), enrich_blocks(spark, "bars_in_blocks", Params(sma_slow=9), include=("sma",)))


def test_a_hot_symbol_is_spread_over_buckets(spark, daily, tmp_path):
    hot = daily.filter(F.col("symbol") == 1)
    long = daily
    for k in range(1, 30):
        long = long.unionByName(hot.withColumn("bar_date", F.date_add("bar_date", 4000 * k)))
    write_blocks(long, "bars_hot", 8, block_rows=345, path=str(tmp_path / "hot"))
    files = spark.read.table("bars_hot").filter(F.col("symbol") == 1).groupBy(F.input_file_name()).count()
    assert files.count() >= 6


def test_resumed_runs_equal_one_run(spark, daily):
    """A short history, one day, and a long rest; each run's result is stored, as a deployment does."""
    cuts = ("1995-03-20", "1995-03-21", "1999-05-05")
    history = staged(enrich(in_range(daily, None, cuts[0]), positions=True), "history")
    state = staged(series_state(history), "state")
    for start, end in zip(cuts, [*cuts[1:], None]):
        out = staged(resume(state, in_range(daily, start, end), block_rows=345), "out")
        state = staged(series_state(advance(state, out)), "state")
        history = staged(advance(history, out), "history")
    same(staged(enrich(daily, positions=True), "whole"), history)


def test_resume_reads_no_history(spark, daily, tmp_path):
    write_enriched(enrich(in_range(daily, None, "1998-01-01"), positions=True), str(tmp_path / "history"))
    state = series_state(spark.read.parquet(str(tmp_path / "history")).drop("bar_year"))
    state.write.parquet(str(tmp_path / "state"))
    in_range(daily, "1998-01-01").write.parquet(str(tmp_path / "new"))
    out = resume(spark.read.parquet(str(tmp_path / "state")), spark.read.parquet(str(tmp_path / "new")))
    assert {f.rsplit("/", 2)[1] for f in out.inputFiles()} == {"state", "new"}
    rows = spark.read.parquet(str(tmp_path / "state")).groupBy("symbol").count().agg(F.max("count")).first()[0]
    assert rows <= 346


def test_late_bars_and_missing_positions_raise(spark, daily):
    state = staged(series_state(enrich(in_range(daily, None, "1998-01-01"), positions=True)), "state")
    with pytest.raises(Exception, match="not later than the state"):
        resume(state, in_range(daily, "1997-12-01")).collect()
    with pytest.raises(SchemaError, match="positions=True"):
        series_state(enrich(daily))


def test_resume_over_missing_prices(spark):
    """An average that repeats its last value across the cut, and a latch that waits."""
    day = dt.date(2024, 1, 1)
    closes = [10.0 + k % 7 for k in range(40)] + [None] * 30 + [11.0, 12.0, 9.0] + [None] * 3 + [15.0 + k for k in range(20)]
    rows = [("G", day + dt.timedelta(days=k), c, c, c, c, c, None) for k, c in enumerate(closes)]
    rows += [("N", day + dt.timedelta(days=k), 5.0, 6.0, 4.0, 5.0 + k % 3, 5.0, 1.0) for k in range(50, 60)]  # begins later
    bars = spark.createDataFrame(rows, BARS_DDL)
    whole = staged(enrich(bars, positions=True), "whole")
    for cut in (45, 69, 74):
        at = day + dt.timedelta(days=cut)
        history = staged(enrich(in_range(bars, None, at), positions=True), "history")
        state = staged(series_state(history), "state")
        same(whole, advance(history, staged(resume(state, in_range(bars, at)), "out")))
