"""V2-V9: chart-ready series, tall ``(symbol, bar_date, series, value)``.

The reference draws nine figures from one frame; here each figure is the same
reshaping (``unpivot``, a narrow Expand, no shuffle) with another column list.
Missing points (NULL, e.g. no signal on a bar) are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.operators.indicators import DEFAULT, Params, col_names

LEVEL_CHARTS = ("price_overlay", "sma", "ema", "bollinger", "levels")  # charts with level lines


def chart_columns(chart: str, p: Params = DEFAULT) -> list[str]:
    """The traces of each figure, in the reference's drawing order."""
    n = col_names(p)
    averages = {"sma": [n["sma_fast"], n["sma_slow"]], "ema": [n["ema_fast"], n["ema_slow"]]}
    bands = ["bb_upper", "bb_lower"]
    return {
        "price_overlay": ["adj_close", *averages["sma"], *averages["ema"], *bands,
                          "sma_buy", "sma_sell", "ema_buy", "ema_sell"],
        "sma": ["adj_close", *averages["sma"], "sma_buy", "sma_sell"],
        "ema": ["adj_close", *averages["ema"], "ema_buy", "ema_sell"],
        "bollinger": ["adj_close", *bands],
        "levels": ["adj_close"],
        "stochastic": ["stoch_k", "stoch_d", "stoch_buy", "stoch_sell"],
        "rsi": ["rsi"],
        "volume": ["volume"],
    }[chart]


SERIES_COLUMNS = ["symbol", "bar_date", "series", "value"]


def to_series(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unpivot ``columns`` of an enriched frame to tall points, NULL points dropped."""
    wide = df.select("symbol", "bar_date", *[F.col(c).cast("double").alias(c) for c in columns])
    return (wide.unpivot(["symbol", "bar_date"], list(columns), "series", "value")
            .filter(F.col("value").isNotNull()))


def level_lines(df: DataFrame, last_levels: DataFrame) -> DataFrame:
    """Each symbol's last support/resistance as a flat line from its first to its
    last bar: two points per line (series ``support`` / ``resistance``)."""
    span = df.groupBy("symbol").agg(F.min("bar_date").alias("_first"), F.max("bar_date").alias("_last"))
    lines = last_levels.select("symbol", "kind", "level").join(span, "symbol")
    return lines.select("symbol", F.explode(F.array("_first", "_last")).alias("bar_date"),
                        F.col("kind").alias("series"), F.col("level").alias("value"))


def chart_series(df: DataFrame, columns: Sequence[str], last_levels: DataFrame | None = None) -> DataFrame:
    """One figure's points; with ``last_levels`` the level lines are added too."""
    points = to_series(df, columns)
    if last_levels is not None:
        points = points.unionByName(level_lines(df, last_levels))
    return points
