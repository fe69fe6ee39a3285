"""Latest close, high and low per symbol (rule Q17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.functions.scalar import round2


def latest_snapshot(bars: DataFrame) -> DataFrame:
    """Last bar by date per symbol, prices rounded half-even to 2 decimals.

    One ``max_by`` per column (fixed-width buffers, so a hash aggregate with map-side
    partial aggregation); ``(symbol, bar_date)`` is unique, so all pick the same bar.
    """
    return bars.groupBy("symbol").agg(
        F.max("bar_date").alias("bar_date"),
        round2(F.max_by("close", "bar_date")).alias("close"),
        round2(F.max_by("high", "bar_date")).alias("high"),
        round2(F.max_by("low", "bar_date")).alias("low"))
