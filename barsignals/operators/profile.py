"""One profile row per symbol.

The reference's page shows, for one symbol, the last-bar metrics, the last levels,
the fundamentals and the vote pie side by side, and feeds the frame to a report
generator. Here that is one row per symbol: last close/high/low (A1), last
indicator values, the last signal of each rule, the last support and resistance
(A2), plus optional fundamentals and vote counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.functions.scalar import CHART_TITLES, chart_title, round2, symbol_base
from barsignals.operators.indicators import DEFAULT, Params, col_names
from barsignals.operators.signals import RULES


def last_indicators(p: Params = DEFAULT) -> list[str]:
    n = col_names(p)
    return [n["sma_fast"], n["sma_slow"], n["ema_fast"], n["ema_slow"], "bb_upper", "bb_lower", "stoch_k", "stoch_d", "rsi"]


def last_values(enriched: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per symbol, in one grouped aggregation (partial aggregation before the shuffle):
    last bar date, rounded last close/high/low, last indicator values, and per rule
    the side, price and date of the last signal."""
    d = F.col("bar_date")
    aggs = [F.max(d).alias("last_date"),
            round2(F.max_by("close", d)).alias("close"),
            round2(F.max_by("high", d)).alias("high"),
            round2(F.max_by("low", d)).alias("low")]
    aggs += [F.max_by(c, d).alias(c) for c in last_indicators(params) if c in enriched.columns]
    for r in RULES:
        if f"{r}_buy" not in enriched.columns:
            continue
        buy, sell = F.col(f"{r}_buy"), F.col(f"{r}_sell")
        fired = buy.isNotNull() | sell.isNotNull()
        when_fired = F.when(fired, d)
        aggs += [F.max_by(F.when(buy.isNotNull(), F.lit("BUY")).when(sell.isNotNull(), F.lit("SELL")),
                          when_fired).alias(f"{r}_last_signal"),
                 F.max_by(F.coalesce(buy, sell), when_fired).alias(f"{r}_last_price"),
                 F.max(when_fired).alias(f"{r}_last_date")]
    return enriched.groupBy("symbol").agg(*aggs)


def levels_wide(last_levels: DataFrame) -> DataFrame:
    """Last support and resistance side by side (at most two rows per symbol in)."""
    k = F.col("kind")
    return last_levels.groupBy("symbol").agg(
        F.max(F.when(k == "support", F.col("level"))).alias("last_support"),
        F.max(F.when(k == "resistance", F.col("level"))).alias("last_resistance"))


def symbol_profile(enriched: DataFrame, last_levels: DataFrame | None = None,
                   fundamentals: DataFrame | None = None, votes: DataFrame | None = None,
                   params: Params = DEFAULT) -> DataFrame:
    """Left joins on ``symbol`` (votes on the symbol without exchange suffix, F1).

    Every side has one row per symbol, so no join key is skewed; adaptive
    execution picks broadcast joins when the sides measure small.
    """
    out = last_values(enriched, params).withColumn("title", chart_title("symbol", CHART_TITLES["price_overlay"]))
    if last_levels is not None:
        out = out.join(levels_wide(last_levels), "symbol", "left")
    if fundamentals is not None:
        out = out.join(fundamentals, "symbol", "left")
    if votes is not None:
        v = votes.withColumnRenamed("symbol", "_vote_symbol")
        out = (out.join(v, symbol_base(F.col("symbol")) == F.col("_vote_symbol"), "left")
               .drop("_vote_symbol"))
    return out
