"""Golden series and edge series from FIXTURES.md."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsignals import Params, enrich, latest_snapshot, levels, support_resistance
from barsignals.functions.scalar import symbol_base
from golden import BARS_DDL, golden_bars, golden_rows

GOLD_TO_COL = {"sma5": "sma5", "sma15": "sma15", "bb_up": "bb_upper", "bb_lo": "bb_lower", "ema5": "ema5",
               "ema15": "ema15", "k": "stoch_k", "d": "stoch_d", "rsi": "rsi"}


def series(spark, closes, symbol="S", highs=None, lows=None):
    rows = []
    for i, c in enumerate(closes):
        h = highs[i] if highs else c
        lo = lows[i] if lows else c
        rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), c, h, lo, c, c, 1.0))
    return spark.createDataFrame(rows, BARS_DDL)


def column(df, name):
    return [r[name] for r in df.orderBy("bar_date").collect()]


def approx(got, want, tol=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None:
            assert g is None, (got, want)
        else:
            assert g is not None and abs(g - w) <= tol, (got, want)


def signal_letters(row, rule):
    if row[f"{rule}_buy"] is not None:
        return "B"
    if row[f"{rule}_sell"] is not None:
        return "S"
    return None


def test_golden_series_all_columns(spark):
    out = enrich(spark.createDataFrame(golden_bars(), BARS_DDL)).orderBy("bar_date").collect()
    gold = golden_rows()
    assert len(out) == len(gold) == 40
    for g, o in zip(gold, out):
        for gk, col in GOLD_TO_COL.items():
            if g[gk] is None:
                assert o[col] is None, (g["t"], col)
            else:
                assert o[col] == pytest.approx(g[gk], abs=5e-5), (g["t"], col)
        assert signal_letters(o, "sma") == g["sma"]
        assert signal_letters(o, "ema") == g["ema"]
        assert signal_letters(o, "stoch") == g["sto"]
        assert {"support": "sup", "resistance": "res"}.get(o["extremum"]) == g["ext"]
        price = o["sma_buy"] or o["sma_sell"] or o["ema_buy"] or o["ema_sell"]
        if price is not None:
            assert price == pytest.approx(g["adj_close"])  # signal price is Adj Close, not Close


def test_golden_levels_and_snapshot(spark):
    bars = spark.createDataFrame(golden_bars(), BARS_DDL)
    lv = levels(bars).orderBy("bar_date").collect()
    sup = [r["level"] for r in lv if r["kind"] == "support"]
    res = [r["level"] for r in lv if r["kind"] == "resistance"]
    assert sup == [108.63, 85.71, 107.15, 88.73, 88.13]
    assert res == [109.46, 113.20, 114.17, 107.39, 91.01]
    last = {r["kind"]: r["level"] for r in support_resistance(bars).collect()}
    assert last == {"support": 88.13, "resistance": 91.01}
    snap = latest_snapshot(bars).collect()[0]
    assert (snap["close"], snap["high"], snap["low"]) == (106.23, 106.63, 105.13)


def test_ema_with_null(spark):
    out = enrich(series(spark, [1.0, 2.0, None, 4.0, 5.0]), include=("ema",))
    approx(column(out, "ema5"), [1, 1.6, 1.6, 2.978723, 3.914286])


def test_rolling_mean_and_std_with_null(spark):
    p = Params(sma_fast=2, bb_n=2)
    out = enrich(series(spark, [1.0, 2.0, None, 4.0, 5.0]), p, include=("sma",))
    approx(column(out, "sma2"), [None, 1.5, None, None, 4.5])
    approx(column(out, "std2"), [None, 0.707107, None, None, 0.707107])


@pytest.mark.parametrize("closes,want", [
    ([1, 2, 3, 4, 5, 6, 7], [None] * 4 + [100, 100, 100]),
    ([7, 6, 5, 4, 3, 2, 1], [None] * 4 + [0, 0, 0]),
    ([3] * 7, [None] * 7),
    ([1, 2, 1.5, 1.7, 1.2, 1.9, 2.1], [None] * 4 + [54.545455, 65.517241, 52.380952]),
    ([1, 2, None, 4, 5, 4, 3, 2], [None] * 4 + [100, 66.666667, 33.333333, 25]),
])
def test_rsi_edges(spark, closes, want):
    closes = [None if c is None else float(c) for c in closes]
    approx(column(enrich(series(spark, closes), include=("rsi",)), "rsi"), want)


def test_flat_price_gives_no_signal(spark):
    out = enrich(series(spark, [0.1] * 40)).collect()
    for r in out:
        for rule in ("sma", "ema", "stoch"):
            assert r[f"{rule}_buy"] is None and r[f"{rule}_sell"] is None
        assert r["stoch_k"] is None


@pytest.mark.parametrize("closes", [[100.0, 98.0, 101.0, 97.0, 99.5, 96.0], [60.0, 50.0, 60.0]])
def test_levels_within_band_or_single_vanish(spark, closes):
    # supports 98/97/96 lie within 3 % of each other; the second series has one support
    kinds = {r["kind"] for r in levels(series(spark, closes)).collect()}
    assert "support" not in kinds


def test_rounding_as_numpy(spark):
    import numpy as np
    vals = [0.125, 0.375, 1.005, 2.675, 1.015, 10.075, *(np.random.default_rng(1).integers(0, 10**8, 500) / 1000).tolist()]
    bars = spark.createDataFrame([(f"S{i}", dt.date(2020, 1, 1), *([v] * 5), 1.0) for i, v in enumerate(vals)],
                                 BARS_DDL)
    got = {r["symbol"]: r["close"] for r in latest_snapshot(bars).collect()}
    assert [got[f"S{i}"] for i in range(len(vals))] == np.round(vals, 2).tolist()
    assert got["S4"] == 1.01 and got["S5"] == 10.07


def test_symbol_base(spark):
    df = spark.createDataFrame([("ACME.NS",), ("A.B.C",), ("AAA",)], "s string")
    assert [r[0] for r in df.select(symbol_base("s")).collect()] == ["ACME", "A", "AAA"]


def test_second_symbol_does_not_change_first(spark):
    gold = golden_bars()
    rev = [("BBB.NS", g[1], *reversed_row) for g, reversed_row in
           zip(gold, [r[2:] for r in reversed(gold)])]
    both = spark.createDataFrame(gold + rev, BARS_DDL)
    alone = spark.createDataFrame(gold, BARS_DDL)
    a = enrich(alone).orderBy("bar_date").collect()
    b = enrich(both).filter(F.col("symbol") == "AAA.NS").orderBy("bar_date").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_nan_input_is_missing_not_a_value(spark):
    nan = float("nan")
    with_nan = enrich(series(spark, [1.0, 2.0, nan, 4.0, 5.0]), include=("ema", "sma"))
    with_null = enrich(series(spark, [1.0, 2.0, None, 4.0, 5.0]), include=("ema", "sma"))
    assert [tuple(r) for r in with_nan.orderBy("bar_date").collect()][0][8:] == \
        [tuple(r) for r in with_null.orderBy("bar_date").collect()][0][8:]
    approx(column(with_nan, "ema5"), [1, 1.6, 1.6, 2.978723, 3.914286])
    assert column(with_nan, "close")[2] is None


def test_sma_within_window_range(spark):
    closes = [float(x) for x in [5, 9, 2, 7, 7, 1, 8, 3, 6, 4, 10, 2, 9, 5, 6, 1, 7]]
    got = column(enrich(series(spark, closes), include=("sma",)), "sma5")
    for i, v in enumerate(got):
        if v is not None:
            window = closes[i - 4:i + 1]
            assert min(window) <= v <= max(window)
