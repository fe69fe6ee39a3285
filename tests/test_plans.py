"""Plan shapes: no window over a whole symbol, shared exchanges, pushed filters, nothing computed unasked."""

from __future__ import annotations

import re

from barsignals.operators.votes import vote_share
from barsignals.plans import bindings as B
from barsignals.plans.enrich import enrich
from barsignals.plans.queries import QUERIES
from paths import SF_SMALL


def _strip(s: str) -> str:
    return re.sub(r"#\d+L?", "", s)


def executed(df) -> str:
    return _strip(df._jdf.queryExecution().executedPlan().toString())


def final(df) -> str:
    """The adaptive plan as it ran."""
    df._jdf.queryExecution()
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return executed(df).split("== Initial Plan ==")[0]


def stored_bars(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.lineitem_bars(spark, SF_SMALL, "day").write.parquet(path)
    return spark.read.parquet(path)


def test_enriched_plan_shape(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    bars = stored_bars(spark, tmp_path)
    spark.sparkContext.setJobGroup("enrich", "enrich")
    out = enrich(bars)
    assert not tracker.getJobIdsForGroup("enrich")  # no job before the caller's action
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = final(out)
    own = "\n".join(x for x in plan.splitlines() if "ReusedExchange" not in x)
    real = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", own)
    keys = [", ".join(k.split(", ")[:-1]) for k in real]
    assert len(re.findall(r"ReusedExchange", plan)) >= 1
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    assert windows and all(w.startswith("symbol, _") or w == "symbol" for w in windows)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert keys.count("symbol, _blk") == 1  # all readers of the laid-out bars share it
    assert keys.count("symbol, _seg") == 2 and len(re.findall(r"FileScan", plan)) == 2  # bars, and the count table's keys


def test_volume_chart_has_no_window(spark):
    plan = executed(QUERIES["volume_chart"](spark, SF_SMALL))
    assert "Window" not in plan


def test_sma_signals_compute_no_ema(spark):
    plan = executed(QUERIES["sma_signals"](spark, SF_SMALL))
    assert not re.search(r"\bema\d|_ema\b|stoch", plan)


def test_ranges_reach_the_tick_scan(spark):
    ranged = B.lineitem_bars(spark, SF_SMALL, "month", B.RANGE_START, B.RANGE_END, B.watchlist(spark, SF_SMALL))
    plan = executed(ranged)
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # printed from the top: the semi-join is below


def test_vote_share_is_one_exchange(spark):
    plan = executed(vote_share(B.event_votes(spark, SF_SMALL)))
    assert len(re.findall(r"Exchange ", plan)) == 1
