"""Sources, sinks, filters, level filter against its definition, votes, profile, plans."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from barsignals import (FUNDAMENTALS_SCHEMA, bars_from_ticks, default_range, enrich, filter_levels, for_symbols,
                        in_range, load_bars, load_fundamentals, select_existing, votes_from_tall)
from barsignals.functions.scalar import vote_chart_title
from barsignals.operators.charts import level_lines, to_series
from barsignals.operators.indicators import DEFAULT, apply_stages, merge_stages, moving_average_stages, rsi_stages
from barsignals.operators.layout import lay_out, make_layout
from barsignals.operators.profile import symbol_profile
from barsignals.operators.votes import vote_share
from barsignals.plans import bindings as B
from barsignals.plans.catalog import register_views
from barsignals.sources.sinks import write_enriched
from paths import SF_SMALL
from golden import BARS_DDL, golden_bars


def test_bars_from_ticks_first_last_by_tiebreak(spark):
    ts = dt.datetime(2024, 1, 1, 9, 0)
    ticks = spark.createDataFrame([
        ("A", ts, 2, 10.0, 1.0), ("A", ts, 1, 11.0, 2.0), ("A", ts + dt.timedelta(hours=1), 1, 9.0, 3.0),
        ("A", ts + dt.timedelta(days=1), 1, 12.0, 1.0), ("A", ts, 3, None, 5.0)],
        "sym string, ts timestamp_ntz, seq int, px double, qty double")
    bars = bars_from_ticks(ticks, "sym", "ts", "px", "qty", unit="day", tiebreak=("seq",), adj_factor=0.5)
    rows = {r["bar_date"]: r for r in bars.collect()}
    first = rows[dt.date(2024, 1, 1)]
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (11.0, 11.0, 9.0, 9.0, 6.0)
    assert first["adj_close"] == 4.5
    hourly = bars_from_ticks(ticks, "sym", "ts", "px", None, unit="hour", tiebreak=("seq",))
    assert dict(hourly.dtypes)["bar_date"] == "timestamp_ntz"
    assert hourly.count() == 3


def test_load_bars_csv_parquet_roundtrip(spark, tmp_path):
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    csv = str(tmp_path / "bars_csv")
    bars.write.option("header", "true").csv(csv)
    back = load_bars(spark, csv, fmt="csv", start="2024-01-05", end="2024-01-10")
    assert back.count() == 5
    out = str(tmp_path / "enriched")
    write_enriched(enrich(bars), out)
    again = load_bars(spark, out, symbols=["AAA.NS"])
    assert again.count() == 40 and "bar_year" in again.columns
    with pytest.raises(Exception, match="exists"):
        write_enriched(enrich(bars), out)
    other = bars.withColumn("bar_date", F.add_months("bar_date", 24))
    write_enriched(other, out, mode="overwrite")  # replaces the years it holds, not the others
    assert load_bars(spark, out).count() == 80


def test_filters(spark, tmp_path):
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    start, end = default_range(dt.date(2024, 2, 1), 10)
    assert (start, end) == (dt.date(2024, 1, 22), dt.date(2024, 2, 1))
    assert in_range(bars, start, end).count() == 10
    assert for_symbols(bars, []).count() == 0
    assert for_symbols(bars, spark.createDataFrame([("AAA.NS",)], "s string")).count() == 40
    assert select_existing(bars, ["close", "nope", "high"]).columns == ["close", "high"]
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    loaded = load_bars(spark, path, symbols=["AAA.NS"], start="2024-01-05", end="2024-01-10")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = loaded._jdf.queryExecution().explainString(mode)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "GreaterThanOrEqual(bar_date" in pushed and "LessThan(bar_date" in pushed
    assert "EqualTo(symbol" in pushed
    assert loaded.count() == 5


def test_level_filter_equals_pairwise_definition(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(60):
        base = rnd.uniform(10, 100)
        for i in range(rnd.randint(1, 8)):
            rows.append((f"S{g}", rnd.choice(["support", "resistance"]), dt.date(2020, 1, 1) + dt.timedelta(days=i),
                         base * (1 + rnd.uniform(-0.04, 0.04))))
    lv = spark.createDataFrame(rows, "symbol string, kind string, bar_date date, level double")
    a, b = lv.alias("a"), lv.alias("b")
    cond = ((F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.kind") == F.col("b.kind"))
            & (F.abs(F.col("a.level") - F.col("b.level")) > 0.03 * F.col("a.level")))
    want = sorted(tuple(r) for r in a.join(b, cond, "left_semi").collect())
    got = sorted(tuple(r) for r in filter_levels(lv).collect())
    assert got == want
    assert 0 < len(got) < len(rows)


def test_fundamentals_missing_keys_are_null(spark):
    docs = spark.createDataFrame([("A", '{"profitMargins": 0.1, "totalCash": 5, "longBusinessSummary": "x"}'),
                                  ("B", '{"debtToEquity": 2.5}')], "symbol string, info string")
    out = {r["symbol"]: r for r in load_fundamentals(docs, "info").collect()}
    assert out["A"]["profitMargins"] == 0.1 and out["A"]["totalCash"] == 5 and out["A"]["debtToEquity"] is None
    assert out["B"]["debtToEquity"] == 2.5 and out["B"]["longBusinessSummary"] is None
    assert [f.name for f in FUNDAMENTALS_SCHEMA.fields][0] == "profitMargins"


def test_vote_share_with_absent_labels(spark):
    tall = spark.createDataFrame([("X", "BUY")] * 7 + [("X", "SELL")] * 3, "symbol string, label string")
    wide = votes_from_tall(tall, "symbol", "label", ["BUY", "SELL"])
    shares = {r["label"]: r["share"] for r in vote_share(wide).collect()}
    assert shares == {"BUY": 0.7, "SELL": 0.3}


def test_profile_and_charts(spark):
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    e = enrich(bars)
    last = spark.createDataFrame([("AAA.NS", "support", 88.13, dt.date(2024, 2, 5))],
                                 "symbol string, kind string, level double, bar_date date")
    votes = spark.createDataFrame([("AAA", 3, 1)], "symbol string, BUY long, SELL long")
    p = symbol_profile(e, last, None, votes).collect()[0]
    assert (p["close"], p["last_support"], p["BUY"], p["sma_last_signal"], p["ema_last_signal"]) == \
        (106.23, 88.13, 3, "SELL", "BUY")
    assert p["title"] == "AAA.NS Price History with buy and sell signals"
    pts = to_series(e, ["sma5", "sma_buy"]).groupBy("series").count().collect()
    assert {r["series"]: r["count"] for r in pts} == {"sma5": 36, "sma_buy": 1}
    assert level_lines(e, last).count() == 2


def test_adhoc_sql_view(spark):
    register_views(enrich(spark.createDataFrame(golden_bars(), BARS_DDL)), "bars_enriched")
    row = spark.sql("SELECT count(*) AS n, count(ema_buy) AS buys FROM bars_enriched").first()
    assert (row["n"], row["buys"]) == (40, 3)


def _count(plan: str, node: str) -> int:
    return len(re.findall(node, plan))


def test_windows_share_one_exchange_and_sort(spark):
    bars = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("bar_date"),
        F.col("l_extendedprice").alias("high"), F.col("l_extendedprice").alias("low"),
        F.col("l_extendedprice").alias("close")).dropDuplicates(["symbol", "bar_date"])
    laid = lay_out(bars, make_layout(DEFAULT.bounded_lookback(), 1))
    few = apply_stages(laid, merge_stages(moving_average_stages()))._jdf.queryExecution().executedPlan().toString()
    many = apply_stages(laid, merge_stages(moving_average_stages(), rsi_stages()))._jdf.queryExecution() \
        .executedPlan().toString()
    assert _count(few, "Exchange hashpartitioning") == _count(many, "Exchange hashpartitioning")
    assert _count(many, r"Exchange hashpartitioning\(symbol#\d+L, _blk") == 1


def test_watchlist_and_event_bindings(spark):
    assert B.watchlist(spark, SF_SMALL).count() > 0
    assert B.event_votes(spark, SF_SMALL).columns == ["symbol", "BUY", "SELL", "NEUTRAL", "STRONG_BUY"]


def test_load_votes_and_unique_check(spark, tmp_path):
    from barsignals import load_votes
    from barsignals.schema import SchemaError
    path = str(tmp_path / "votes")
    spark.createDataFrame([("ACME", 7, 3, None)], "symbol string, BUY long, SELL long, OTHER long").write.parquet(path)
    votes = load_votes(spark, path)
    assert votes.columns == ["symbol", "BUY", "SELL"]
    assert {r["label"]: r["share"] for r in vote_share(votes).collect()} == {"BUY": 0.7, "SELL": 0.3}
    bars = spark.createDataFrame(golden_bars() + golden_bars()[:1], BARS_DDL)
    dup = str(tmp_path / "dup")
    bars.write.parquet(dup)
    with pytest.raises(SchemaError):
        load_bars(spark, dup, check_unique=True)
    with pytest.raises(Exception, match="duplicate"):  # without a check on load, rows without a position raise
        enrich(load_bars(spark, dup), include=("sma",)).collect()
    for column in ("symbol", "bar_date"):
        keyless = spark.createDataFrame(golden_bars(), BARS_DDL).withColumn(
            column, F.when(F.col("close") > 100, F.col(column)))
        with pytest.raises(Exception, match="no symbol or bar_date"):
            enrich(keyless, include=("sma",)).collect()


def test_extra_columns_stay(spark):
    from barsignals.schema import SchemaError
    bars = spark.createDataFrame(golden_bars(), BARS_DDL).withColumn("note", F.concat("symbol", F.lit("!")))
    for include in (("sma",), ("signals",), ("extrema", "rsi")):
        out = enrich(bars, include=include)
        assert out.columns[:9][-1] == "note" and out.filter("note = 'AAA.NS!'").count() == 40
    with pytest.raises(SchemaError):
        enrich(bars.withColumnRenamed("note", "rsi"))


def test_rules_compute_only_their_own_columns(spark):
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    whole = {r["bar_date"]: r for r in enrich(bars).collect()}
    for rule, columns in (("sma", ["sma5", "sma15"]), ("ema", ["ema5", "ema15"]), ("stoch", ["stoch_k", "stoch_d"])):
        out = enrich(bars, include=("signals",), rules=(rule,))
        assert [c for c in out.columns if c.endswith(("_buy", "_sell"))] == [f"{rule}_buy", f"{rule}_sell"]
        assert set(columns) <= set(out.columns)
        for r in out.collect():
            assert r[f"{rule}_buy"] == whole[r["bar_date"]][f"{rule}_buy"]
            assert r[f"{rule}_sell"] == whole[r["bar_date"]][f"{rule}_sell"]
    assert not [c for c in enrich(bars, include=("signals",), rules=("sma",)).columns if c.startswith("ema")]


def test_bar_edges(spark):
    from barsignals.sources.bars import bar_key, next_edge
    rnd = random.Random(9)
    times = [dt.datetime(2023, 12, 25) + dt.timedelta(seconds=rnd.randrange(0, 90 * 86400)) for _ in range(60)]
    times += [dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1, 5), dt.datetime(2024, 4, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    for unit in ("year", "quarter", "month", "week", "day", "hour", "minute"):
        keys = [r[0] for r in df.select(bar_key(F.col("ts"), unit)).collect()]
        for end in (dt.date(2024, 1, 1), dt.date(2024, 2, 29), dt.datetime(2024, 2, 1, 5, 0, 1), dt.datetime(2024, 1, 8)):
            edge = next_edge(end, unit)
            as_time = lambda v: v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            assert [as_time(k) < as_time(end) for k in keys] == [t < as_time(edge) for t in times], (unit, end)


def test_nan_ticks_are_no_trades(spark):
    ts = dt.datetime(2024, 1, 1, 9)
    ticks = spark.createDataFrame([("A", ts, 10.0), ("A", ts + dt.timedelta(minutes=1), float("nan")),
                                   ("A", ts + dt.timedelta(minutes=2), 11.0)], "s string, ts timestamp_ntz, px double")
    b = bars_from_ticks(ticks, "s", "ts", "px").collect()[0]
    assert (b["open"], b["high"], b["low"], b["close"], b["volume"]) == (10.0, 11.0, 10.0, 11.0, 2.0)


def test_charts_follow_the_parameters(spark):
    from barsignals import Params, chart, chart_titles
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    p = Params(sma_fast=3, sma_slow=7, bb_n=7)
    assert {"sma3", "sma7"} <= {r["series"] for r in chart(bars, "sma", p).select("series").distinct().collect()}
    profile = symbol_profile(enrich(bars, p), params=p)
    assert {"sma3", "sma7", "ema5"} <= set(profile.columns)
    assert chart_titles(bars).count() == 5


def test_load_bars_json(spark, tmp_path):
    path = str(tmp_path / "bars_json")
    spark.createDataFrame(golden_bars(), BARS_DDL).write.json(path)
    assert load_bars(spark, path, fmt="json", end="2024-01-11").count() == 10


def test_minute_bars_match_duckdb(spark):
    import duckdb
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    bars = bars_from_ticks(ev, "event_type", "ts", "value", None, unit="minute", tiebreak=("event_id",))
    got = sorted((r["symbol"], r["bar_date"], r["open"], r["close"], r["volume"]) for r in bars.collect())
    want = sorted(duckdb.sql(f"""
        SELECT event_type, date_trunc('minute', ts), first(value ORDER BY ts, event_id),
               first(value ORDER BY ts DESC, event_id DESC), CAST(count(*) AS DOUBLE)
        FROM read_parquet('{SF_SMALL}/events.parquet') WHERE value IS NOT NULL AND ts IS NOT NULL
        GROUP BY 1, 2""").fetchall())
    assert got == want


def test_vote_chart_title(spark):
    row = spark.sql("SELECT 'ACME.NS' AS symbol, 'NSE' AS exchange, '1d' AS interval")
    assert row.select(vote_chart_title("symbol", "exchange", "interval")).first()[0] == "Recommendations for ACME on NSE - 1d"
