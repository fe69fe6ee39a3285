"""

One symbol at a time, rows in date order; NaN is the missing value. Every value is
worked out on its own from the rows it depends on (explicit windows, sums over all
earlier rows), not by running through the series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def windows(x: np.ndarray, n: int, f) -> np.ndarray:
    """``f`` of each full window of ``n`` values without a gap."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        view = np.lib.stride_tricks.sliding_window_view(x, n)
        whole = ~np.isnan(view).any(axis=1)
        out[n - 1:][whole] = f(view[whole], axis=1)
    return out


def weighted(x: np.ndarray, span: int) -> np.ndarray:
    """EMA as the weighted mean of all values so far, (1 - 2/(span+1)) ** age."""
    age = np.arange(len(x))[:, None] - np.arange(len(x))[None, :]
    w = np.where((age >= 0) & ~np.isnan(x)[None, :], (1 - 2 / (span + 1)) ** np.maximum(age, 0), 0.0)
    total = w.sum(axis=1)
    out = np.full(len(x), np.nan)
    out[total > 0] = (w @ np.nan_to_num(x))[total > 0] / total[total > 0]
    known = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(known >= 0, out[known], np.nan)


def changes(up: np.ndarray, down: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buys and sells: the conditions in order, repeats struck out, and no sell before the first buy."""
    rows = np.flatnonzero(up | down)
    side = np.where(up[rows], 1, -1)
    fresh = np.concatenate([side[:1] == 1, side[1:] != side[:-1]])
    buy, sell = np.full(len(up), np.nan), np.full(len(up), np.nan)
    for mark, kind in ((buy, 1), (sell, -1)):
        at = rows[fresh & (side == kind)]
        mark[at] = price[at]
    return buy, sell


def relative_strength(close: np.ndarray, n: int) -> np.ndarray:
    """Share of the upward steps in all steps of the last ``n`` rows, in percent."""
    step = np.nan_to_num(np.diff(close, prepend=np.nan))
    rise = windows(np.maximum(step, 0), n, np.sum)
    fall = windows(np.maximum(-step, 0), n, np.sum)
    moved = rise + fall
    return np.where(moved > 0, 100 * rise / np.where(moved > 0, moved, 1), np.nan)


def turning_points(close: np.ndarray) -> list[str | None]:
    """Rows where the direction of strict steps changes sign."""
    before, after = np.sign(np.diff(close))[:-1], np.sign(np.diff(close))[1:]
    kind = {-2: "support", 2: "resistance"}
    inner = [kind.get(int(a - b)) if not np.isnan(a - b) else None for a, b in zip(before, after)]
    return ([None, *inner, None])[:len(close)]


def enrich_one(df: pd.DataFrame) -> pd.DataFrame:
    close, high, low, price = (df[c].to_numpy(float) for c in ("close", "high", "low", "adj_close"))
    out = {f"sma{n}": windows(close, n, np.mean) for n in (5, 15)}
    out["std15"] = windows(close, 15, lambda v, axis: np.std(v, axis=axis, ddof=1))
    for name, sign in (("bb_upper", 1), ("bb_lower", -1)):
        out[name] = out["sma15"] + sign * 2 * out["std15"]
    out |= {f"ema{n}": weighted(close, n) for n in (5, 15)}
    top, bottom = windows(high, 5, np.max), windows(low, 5, np.min)
    width = np.where(top > bottom, top - bottom, np.nan)
    out["stoch_k"] = (close - bottom) / width * 100
    out["stoch_d"] = windows(out["stoch_k"], 3, np.mean)
    out["rsi"] = relative_strength(close, 5)
    for rule in ("sma", "ema"):
        gap = out[f"{rule}5"] - out[f"{rule}15"]
        out[f"{rule}_buy"], out[f"{rule}_sell"] = changes(gap > 0, gap < 0, price)
    lead = out["stoch_k"] - out["stoch_d"]
    far = np.maximum(out["stoch_k"], out["stoch_d"]), np.minimum(out["stoch_k"], out["stoch_d"])
    out["stoch_buy"], out["stoch_sell"] = changes((far[0] < 20) & (lead > 0), (far[1] > 80) & (lead < 0), price)
    return df.assign(**out, extremum=turning_points(close))
