"""What a run from a state may leave on disk or move: shuffle files, replaced tables, wide rows of earlier bars."""

from __future__ import annotations

import datetime as dt
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from barsignals import enrich, in_range
from barsignals.plans.queries import QUERIES
from barsignals.plans.resume import READ_BACK, advance, resume, series_state
from barsignals.staging import shared_folder, staged, unstaged
from golden import BARS_DDL

TICKS_DDL = ("l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, "
             "l_shipdate timestamp_ntz")


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {n for top in dirs for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}


def folders(spark) -> set[str]:
    at = shared_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(at) if x.startswith("staged-")} if os.path.isdir(at) else set()


def bars(spark, days: int = 400):
    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(days=k), c, c + 1.0, c - 1.0, c, c * 0.5, float(k))
            for s in ("A", "B") for k in range(days) for c in [50.0 + (k * 7 + len(s)) % 11 + k % 3]]
    return spark.createDataFrame(rows, BARS_DDL)


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = staged(spark.range(1000).repartition(3, "id"), "dealt")
    until = time.time() + 5
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and rows.count() == 1000


def test_unstaged_deletes_only_staging_tables(spark, tmp_path):
    rows = staged(spark.range(10), "gone")
    at = rows.inputFiles()[0].rsplit("/", 1)[-2].rsplit("/", 1)[-1]
    assert at in folders(spark)
    unstaged(rows)
    assert at not in folders(spark)
    spark.range(10).write.parquet(str(tmp_path / "kept"))
    with pytest.raises(ValueError, match="not a staging table"):
        unstaged(spark.read.parquet(str(tmp_path / "kept")))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 10


def test_a_state_is_narrow_but_for_its_newest_bar(spark):
    history = staged(enrich(bars(spark), positions=True), "history")
    state = series_state(history)
    assert state.schema.names == history.schema.names and [f.dataType for f in state.schema] == [f.dataType for f in history.schema]
    rows = state.collect()
    newest = {r["symbol"]: r["bar_date"] for r in history.groupBy("symbol").agg(F.max("bar_date").alias("bar_date")).collect()}
    whole = {(r["symbol"], r["bar_date"]): r for r in history.collect()}
    assert len(rows) == 2 * 346
    for r in rows:
        was = whole[r["symbol"], r["bar_date"]]
        if r["bar_date"] == newest[r["symbol"]]:
            assert r == was
        else:
            assert [r[c] for c in READ_BACK] == [was[c] for c in READ_BACK]
            assert all(r[c] is None for c in r.__fields__ if c not in READ_BACK)


def test_a_state_and_new_bars_are_moved_once(spark, tmp_path):
    staged(series_state(enrich(in_range(bars(spark), None, "2020-12-01"), positions=True)), "s").write.parquet(str(tmp_path / "state"))
    in_range(bars(spark), "2020-12-01").write.parquet(str(tmp_path / "new"))
    out = resume(spark.read.parquet(str(tmp_path / "state")), spark.read.parquet(str(tmp_path / "new")))
    out.collect()
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[0]
    moved = "\n".join(x for x in plan.splitlines() if "ReusedExchange" not in x)
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", moved)
    assert keys.count("symbol, _blk") == 1 and keys.count("symbol, _seg") == 2  # the bars, and the count table's keys
    assert "symbol, bar_date" not in keys and not re.search(r"LeftSemi|LeftAnti", plan)


def test_a_state_of_whole_rows_gives_the_same(spark):
    """As stored before states were narrow."""
    history = staged(enrich(in_range(bars(spark), None, "2020-12-01"), positions=True), "history")
    state = series_state(history)
    wide = history.join(state.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_semi").select(*history.columns)
    new = in_range(bars(spark), "2020-12-01")
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(resume(state, new))
    assert got == rows(resume(wide, new)) and len(got) == new.count() + 2


def test_symbols_without_new_bars_or_state(spark):
    day = "2020-12-01"
    b = bars(spark)
    old, new = in_range(b, None, day), in_range(b, day).filter("symbol = 'A'")
    new = new.unionByName(in_range(b, day).filter("symbol = 'B'").withColumn("symbol", F.lit("C")))
    history = staged(enrich(old, positions=True), "history")
    state = staged(series_state(history), "state")
    out = staged(resume(state, new), "out")
    rows = lambda df: sorted(map(str, df.select(*history.columns).collect()))
    assert rows(advance(history, out)) == rows(enrich(old.unionByName(new), positions=True))
    again = staged(series_state(advance(state, out)), "state")
    assert rows(again) == rows(series_state(advance(history, out)))


def test_a_resumed_query_keeps_only_what_its_result_reads(spark, tmp_path):
    day = dt.datetime(1996, 6, 1)
    ticks = [(k * 10 + s, 1, s, 1.0 + k % 5, 100.0 + (k * 13 + s * 5) % 29, day + dt.timedelta(days=k + k // 6))
             for s in (1, 2, 3) for k in range(700)]
    spark.createDataFrame(ticks, TICKS_DDL).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = folders(spark)
    out = QUERIES["enriched_resumed"](spark, str(tmp_path))
    kept = sorted(re.sub(r"-[0-9a-f]{32}$", "", x) for x in folders(spark) - before)
    assert kept == ["staged-history", "staged-resumed", "staged-resumed", "staged-state"]
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(out)
    assert len(got) == 3 * 700 and got == rows(QUERIES["enriched_daily"](spark, str(tmp_path)).select(*out.columns))
