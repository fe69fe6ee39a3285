"""enrich() against the pandas statement of the semantics, on random walks with gaps,
several symbols of different lengths, and blocks small enough to need the carry."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barsignals import enrich
from golden import BARS_DDL
from spec import enrich_one

NUMERIC = ["sma5", "sma15", "std15", "bb_upper", "bb_lower", "ema5", "ema15", "stoch_k", "stoch_d", "rsi",
           "sma_buy", "sma_sell", "ema_buy", "ema_sell", "stoch_buy", "stoch_sell"]


def random_bars(seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for sym, n in (("A.NS", 900), ("B.NS", 40), ("C.NS", 400)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        spread = close * rng.uniform(0.001, 0.03, n)
        high, low = close + spread * rng.uniform(0, 1, n), close - spread * rng.uniform(0, 1, n)
        gaps = rng.random(n) < 0.01
        close[gaps] = np.nan
        dates = [dt.date(2001, 1, 1) + dt.timedelta(days=int(d)) for d in np.sort(rng.choice(5 * n, n, replace=False))]
        frames.append(pd.DataFrame({"symbol": sym, "bar_date": dates, "open": close, "high": high, "low": low,
                                    "close": close, "adj_close": close * 0.97, "volume": rng.integers(1, 99, n) * 1.0}))
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("seed,block_rows,fanout", [(1, 8192, 4096), (2, 345, 2)])
def test_enrich_matches_pandas_spec(spark, seed, block_rows, fanout):
    pdf = random_bars(seed)
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
            for r in pdf[["symbol", "bar_date", "open", "high", "low", "close", "adj_close", "volume"]]
            .itertuples(index=False)]
    got = (enrich(spark.createDataFrame(rows, BARS_DDL), block_rows=block_rows, carry_fanout=fanout)
           .toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True))
    want = (pd.concat([enrich_one(g.reset_index(drop=True)) for _, g in pdf.groupby("symbol", sort=True)])
            .sort_values(["symbol", "bar_date"]).reset_index(drop=True))
    assert len(got) == len(want)
    for col in NUMERIC:
        g, w = got[col].to_numpy(dtype=float), want[col].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(g), np.isnan(w)), col
        ok = ~np.isnan(w)
        assert np.allclose(g[ok], w[ok], rtol=1e-9, atol=1e-7), col
    assert list(got["extremum"]) == list(want["extremum"])
    assert np.isfinite(got["sma_buy"]).sum() > 3 and np.isfinite(got["stoch_buy"]).sum() > 3
