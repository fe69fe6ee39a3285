"""The skew-safe layout: results do not depend on the block size, a long series is
split into bounded groups, EMA matches pandas across NULL stretches and blocks."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsignals import enrich
from barsignals.operators.layout import lay_out, make_layout
from barsignals.plans import bindings as B
from paths import SF_MID
from golden import BARS_DDL


@pytest.fixture(scope="module")
def daily(spark):
    # ~530 daily bars per supplier: several blocks per symbol at block_rows=345
    return B.lineitem_bars(spark, SF_MID, "day").cache()


def _rows(df):
    return {(r["symbol"], r["bar_date"]): r.asDict() for r in df.collect()}


def test_block_size_does_not_change_results(spark, daily):
    big = _rows(enrich(daily))
    small = _rows(enrich(daily, block_rows=345, carry_fanout=1))
    assert big.keys() == small.keys()
    for key, a in big.items():
        b = small[key]
        for col, va in a.items():
            vb = b[col]
            if isinstance(va, float):
                assert vb is not None and abs(va - vb) <= 1e-9 * max(1.0, abs(va)), (key, col, va, vb)
            else:
                assert va == vb, (key, col, va, vb)


def test_hot_symbol_is_split_into_bounded_groups(spark, daily):
    # one symbol holds about a third of all rows: its bars are repeated under shifted dates
    hot = daily.filter(F.col("symbol") == 1)
    copies = [hot.withColumn("bar_date", F.date_add("bar_date", 4000 * i)) for i in range(1, 40)]
    skewed = daily
    for c in copies:
        skewed = skewed.unionByName(c)
    layout = make_layout(345, 1, block_rows=690)
    sizes = lay_out(skewed, layout).groupBy("symbol", "_blk").count()
    assert sizes.agg(F.max("count")).first()[0] <= layout.block + layout.back + layout.ahead
    n_hot = skewed.filter(F.col("symbol") == 1).count()
    assert n_hot > skewed.count() / 4
    assert sizes.filter(F.col("symbol") == 1).count() >= n_hot // layout.block


def test_ema_long_gap_matches_pandas(spark):
    n = 2600
    x = np.cumsum(np.random.default_rng(7).normal(0, 1, n)) + 100.0
    x[0] = np.nan
    x[100:400] = np.nan
    x[700:705] = np.nan
    x[1000] = np.nan
    want5 = pd.Series(x).ewm(span=5).mean().to_numpy()
    want15 = pd.Series(x).ewm(span=15).mean().to_numpy()
    start = dt.date(2000, 1, 1)
    rows = [("G", start + dt.timedelta(days=i), None if np.isnan(v) else float(v), None, None,
             None if np.isnan(v) else float(v), None, None) for i, v in enumerate(x)]
    bars = spark.createDataFrame(rows, BARS_DDL)
    for block_rows, fanout in ((8192, 4096), (345, 2), (345, 1)):
        got = enrich(bars, include=("ema",), block_rows=block_rows, carry_fanout=fanout).orderBy("bar_date").toPandas()
        for col, want in (("ema5", want5), ("ema15", want15)):
            g = got[col].to_numpy(dtype=float)
            assert np.array_equal(np.isnan(g), np.isnan(want)), (block_rows, col)
            ok = ~np.isnan(want)
            assert np.max(np.abs(g[ok] - want[ok]) / np.abs(want[ok])) < 1e-12, (block_rows, col)
        assert np.isnan(got["ema5"].to_numpy(dtype=float)).sum() == 1


def test_signals_alternate_and_start_with_buy(spark, daily):
    out = enrich(daily, block_rows=345).orderBy("symbol", "bar_date").toPandas()
    for rule in ("sma", "ema", "stoch"):
        for _, g in out.groupby("symbol"):
            seq = ["B" if not np.isnan(b) else "S" for b, s in zip(g[f"{rule}_buy"], g[f"{rule}_sell"])
                   if not (np.isnan(b) and np.isnan(s))]
            assert all(seq[i] != seq[i + 1] for i in range(len(seq) - 1)), rule
            assert not seq or seq[0] == "B", rule


def test_indicator_ranges(spark, daily):
    out = enrich(daily).toPandas()
    k, rsi = out["stoch_k"].dropna(), out["rsi"].dropna()
    assert ((k >= 0) & (k <= 100 + 1e-9)).all()
    assert ((rsi >= 0) & (rsi <= 100 + 1e-9)).all()
    assert (out["bb_upper"].dropna() >= out["bb_lower"].dropna() - 1e-9).all()


def test_input_order_does_not_matter(spark, daily):
    a = _rows(enrich(daily.repartition(3)))
    b = _rows(enrich(daily.orderBy(F.rand(5))))
    assert a == b


def test_ema_across_a_block_with_no_values(spark):
    n = 1800
    x = np.cumsum(np.random.default_rng(11).normal(0, 1, n)) + 50.0
    x[400:1200] = np.nan  # block 2 (rows 690-1034) has no value of its own
    want = pd.Series(x).ewm(span=15).mean().to_numpy()
    start = dt.date(2000, 1, 1)
    rows = [("H", start + dt.timedelta(days=i), None if np.isnan(v) else float(v), None, None,
             None if np.isnan(v) else float(v), None, None) for i, v in enumerate(x)]
    got = (enrich(spark.createDataFrame(rows, BARS_DDL), include=("ema",), block_rows=345, carry_fanout=2)
           .orderBy("bar_date").toPandas()["ema15"].to_numpy(dtype=float))
    assert np.max(np.abs(got - want) / np.abs(want)) < 1e-12


def _bars_of(spark, x, symbol="E"):
    start = dt.date(1990, 1, 1)
    return spark.createDataFrame([(symbol, start + dt.timedelta(days=i), *([None if np.isnan(v) else float(v)] * 5), 1.0)
                                  for i, v in enumerate(x)], BARS_DDL)


@pytest.mark.parametrize("params", [{"ema_fast": 5, "ema_slow": 100}, {"ema_fast": 10, "ema_slow": 200},
                                    {"sma_slow": 2000}, {"ema_fast": 12, "ema_slow": 26}])
def test_ema_of_unlike_spans_matches_pandas(spark, params):
    from barsignals import Params
    n = 5200
    x = np.cumsum(np.random.default_rng(3).normal(0, 1, n)) + 500.0
    x[1500:1520] = np.nan
    x[2500:4800:7] = np.nan
    p = Params(**params)
    got = enrich(_bars_of(spark, x), p, include=("ema", "sma"), block_rows=1024, carry_fanout=2).orderBy("bar_date").toPandas()
    for span in (p.ema_fast, p.ema_slow):
        want = pd.Series(x).ewm(span=span).mean().to_numpy()
        g = got[f"ema{span}"].to_numpy(dtype=float)
        assert np.isfinite(g).all() and np.max(np.abs(g - want) / np.abs(want)) < 1e-12, span
    mean = pd.Series(x).rolling(p.sma_slow).mean().to_numpy()
    g = got[f"sma{p.sma_slow}"].to_numpy(dtype=float)
    assert np.array_equal(np.isnan(g), np.isnan(mean)) and np.allclose(g[~np.isnan(mean)], mean[~np.isnan(mean)], rtol=1e-9)
