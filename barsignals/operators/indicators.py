"""Indicator columns over a laid-out frame (see ``operators.layout``).

Each ``*_stages`` function returns its columns as a list of dependency levels
(dicts of column expressions); ``merge_stages`` lines the indicator groups up level
by level and ``apply_stages`` adds each level with one ``withColumns`` to a frame
produced by ``lay_out``. All windows partition by ``(symbol, _blk)`` and share one
sort. Rule Q1: a rolling value is NULL until its window holds ``n`` non-NULL inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsignals.functions.scalar import null_double, safe_div
from barsignals.operators.layout import block_window, ema_sub_blocks, own, sub_window


@dataclass(frozen=True)
class Params:
    # The reference's literal window sizes and thresholds.
    sma_fast: int = 5
    sma_slow: int = 15
    ema_fast: int = 5
    ema_slow: int = 15
    bb_n: int = 15
    bb_k: float = 2.0
    stoch_n: int = 5
    stoch_d: int = 3
    stoch_low: float = 20.0
    stoch_high: float = 80.0
    rsi_n: int = 5
    level_sensitivity: float = 0.03

    def __post_init__(self):
        windows = (self.sma_fast, self.sma_slow, self.bb_n, self.stoch_n, self.stoch_d, self.rsi_n)
        if min(windows) < 1:
            raise ValueError(f"window sizes must be >= 1: {windows}")
        if min(self.ema_fast, self.ema_slow) < 2:
            raise ValueError("EMA spans must be >= 2 (span 1 is the series itself)")

    def bounded_lookback(self) -> int:
        """Rows before ``t`` that any bounded indicator at ``t`` reads."""
        return max(self.sma_slow, self.sma_fast, self.bb_n, self.stoch_n + self.stoch_d, self.rsi_n + 1, 2)

    def ema_sub_blocks(self) -> dict[int, int]:
        return ema_sub_blocks((self.ema_fast, self.ema_slow))


DEFAULT = Params()


def col_names(p: Params = DEFAULT) -> dict[str, str]:
    return {"sma_fast": f"sma{p.sma_fast}", "sma_slow": f"sma{p.sma_slow}",
            "ema_fast": f"ema{p.ema_fast}", "ema_slow": f"ema{p.ema_slow}",
            "std": f"std{p.bb_n}", "hh": f"hh{p.stoch_n}", "ll": f"ll{p.stoch_n}"}


def rolling(n: int) -> Window:
    return block_window().rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], x: Column, n: int) -> Column:
    """Rule Q1: ``agg`` over the last ``n`` rows, NULL unless all ``n`` are non-NULL."""
    w = rolling(n)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def sma(x: Column, n: int) -> Column:
    """W1."""
    return full(F.avg, x, n)


def rolling_std(x: Column, n: int) -> Column:
    """Sample standard deviation (n - 1)."""
    return full(F.stddev_samp, x, n)


def rolling_max(x: Column, n: int) -> Column:
    """W5."""
    return full(F.max, x, n)


def rolling_min(x: Column, n: int) -> Column:
    """W6."""
    return full(F.min, x, n)


Stages = list[dict[str, Column]]


def merge_stages(*groups: Stages) -> Stages:
    """Merge per-indicator stage lists level by level.

    Level ``i`` only reads inputs and columns of levels ``< i``, so every level is
    one ``withColumns`` (one analysis pass, one Window node per frame spec).
    """
    depth = max((len(g) for g in groups), default=0)
    merged: Stages = [{} for _ in range(depth)]
    for g in groups:
        for i, level in enumerate(g):
            merged[i].update(level)
    return [m for m in merged if m]


def apply_stages(df: DataFrame, stages: Stages) -> DataFrame:
    for level in stages:
        df = df.withColumns(level)
    return df


def moving_average_stages(p: Params = DEFAULT) -> Stages:
    """SMA fast/slow, rolling std and Bollinger bands of ``close``."""
    n = col_names(p)
    close = F.col("close")
    mid = F.col(n["sma_slow"]) if p.bb_n == p.sma_slow else F.col("_bb_mid")
    first = {n["sma_fast"]: sma(close, p.sma_fast), n["sma_slow"]: sma(close, p.sma_slow),
             n["std"]: rolling_std(close, p.bb_n)}
    if p.bb_n != p.sma_slow:
        first["_bb_mid"] = sma(close, p.bb_n)
    return [first, {"bb_upper": mid + F.lit(p.bb_k) * F.col(n["std"]),
                    "bb_lower": mid - F.lit(p.bb_k) * F.col(n["std"])}]


def stochastic_stages(p: Params = DEFAULT) -> Stages:
    """Highest high / lowest low over ``stoch_n`` rows, %K and %D (rule Q5).

    %K keeps the reference's order of operations, ``100 * ((c - ll) / (hh - ll))``;
    a zero range gives NULL instead of NaN or infinity.
    """
    n = col_names(p)
    hh, ll = F.col(n["hh"]), F.col(n["ll"])
    return [{n["hh"]: rolling_max(F.col("high"), p.stoch_n), n["ll"]: rolling_min(F.col("low"), p.stoch_n)},
            {"stoch_k": F.lit(100.0) * safe_div(F.col("close") - ll, hh - ll)},
            {"stoch_d": full(F.avg, F.col("stoch_k"), p.stoch_d)}]


def rsi_stages(p: Params = DEFAULT) -> Stages:
    """RSI with simple means of gains and losses (rules Q6-Q8).

    A missing difference (first row, NULL close) counts as gain 0 and loss 0.
    """
    d = F.col("_delta")
    gain = F.when(d > 0, d).otherwise(F.lit(0.0))
    loss = F.when(d < 0, -d).otherwise(F.lit(0.0))
    ag, al = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = (F.when((al == 0) & (ag == 0), null_double())
           .when(al == 0, F.lit(100.0))
           .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_div(ag, al))))
    return [{"_delta": F.col("close") - F.lag("close", 1).over(block_window())},
            {"_avg_gain": full(F.avg, gain, p.rsi_n), "_avg_loss": full(F.avg, loss, p.rsi_n)},
            {"rsi": rsi}]


def extremum_stages() -> Stages:
    """W12 + L1/L2: a close strictly below (above) both positional neighbours.

    The first and last row of a series never qualify (a neighbour is NULL).
    """
    w = block_window()
    prev, nxt, c = F.lag("close", 1).over(w), F.lead("close", 1).over(w), F.col("close")
    kind = (F.when((c < prev) & (c < nxt), F.lit("support"))
            .when((c > prev) & (c > nxt), F.lit("resistance")))
    return [{"extremum": kind}]


def newest_stages() -> Stages:
    """``_newest``: a series' last row that is marked ``_old``. Old rows come first, and the next row is in the block."""
    following = F.lead("_old", 1).over(block_window())
    return [{"_newest": F.col("_old") & ~F.coalesce(following, F.lit(False))}]


def ema_stages(subs: dict[int, int], x: str = "close", known: bool = False) -> Stages:
    """Pandas-style ``ewm(span).mean()`` (normalised weights, rule Q3).

    ``ema_t = sum(r^(t-j) x_j) / sum(r^(t-j))`` over non-NULL ``x_j``, ``r = 1 - 2/(span+1)``.
    ``subs`` gives each span its own sub-block length. The sums run inside sub-blocks
    (scaled by ``r^-k``, which stays below ``exp(2 * 46)`` there), plus the previous
    sub-block's closing sums decayed to the row; older terms weigh below
    ``r^length ~ 1e-20``. Rows with NULL ``x`` repeat the last value. Adds ``ema<span>_local``: NULL where the block's own rows hold no
    value yet; ``carry_last`` fills those from earlier blocks. ``known``: rows marked
    ``_old`` keep the value that they had in the whole series (``_known_ema<span>``).
    """
    xv = F.col(x)
    before = block_window().rowsBetween(Window.unboundedPreceding, -1)
    upto = block_window().rowsBetween(Window.unboundedPreceding, 0)
    sums, prev, values = {}, {}, {}
    for span, length in subs.items():
        k = (F.col("_t") % F.lit(length)).cast("int")
        closing = k == length - 1
        running = sub_window(fine=length < max(subs.values())).rowsBetween(Window.unboundedPreceding, 0)
        r = 1.0 - 2.0 / (span + 1.0)
        inv = F.pow(F.lit(1.0 / r), k)
        scale, decay = F.pow(F.lit(r), k), F.pow(F.lit(r), k + 1)
        s1, s0 = f"_s1_{span}", f"_s0_{span}"
        sums[s1] = F.sum(F.coalesce(xv, F.lit(0.0)) * inv).over(running)
        sums[s0] = F.sum(F.when(xv.isNotNull(), inv).otherwise(F.lit(0.0))).over(running)
        for src in (s1, s0):
            prev[f"_p{src[1:]}"] = F.coalesce(F.last(F.when(closing, F.col(src) * scale), True).over(before),
                                              F.lit(0.0))
        num = F.col(s1) * scale + decay * F.col(f"_ps1_{span}")
        den = F.col(s0) * scale + decay * F.col(f"_ps0_{span}")
        here = F.when(xv.isNotNull(), safe_div(num, den))
        if known:
            here = F.when(F.col("_old"), F.col(f"_known_ema{span}")).otherwise(here)
        values[f"ema{span}_local"] = F.last(own(here), True).over(upto)
    return [sums, prev, values]
