"""S2 on a stream: finished OHLCV bars from a tick stream.

The reference downloads finished bars per page run; with a live tick feed the
same bar operator runs incrementally. Event-time tumbling windows with a
watermark: a bar is emitted once (append mode) when the watermark passes its end,
and the state store drops it. Per-key state is one aggregation buffer per open
bar, so a hot symbol holds one row of state per open bar, not its ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.sources.bars import bar_aggregates, trades

UTC_ZONES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def stream_bars(ticks: DataFrame, symbol: str, ts: str, price: str, volume: str | None = None,
                bar: str = "1 hour", watermark: str = "10 minutes", tiebreak: Sequence[str] = (),
                adj_factor: float | None = None) -> DataFrame:
    """Streaming bars ``(symbol, bar_date, open, high, low, close, adj_close, volume)``.

    ``bar_date`` is the bar's start. Ticks later than the watermark are dropped by
    Spark, as in any watermarked aggregation. Wall-clock (NTZ) ticks need a session in
    UTC: event time must be TIMESTAMP, and in a zone with daylight saving two hours of a
    wall clock would fall into one.
    """
    ntz = dict(ticks.dtypes)[ts] == "timestamp_ntz"
    zone = ticks.sparkSession.conf.get("spark.sql.session.timeZone")
    if ntz and zone not in UTC_ZONES:
        raise ValueError(f"wall-clock ticks need spark.sql.session.timeZone = UTC, not {zone}")
    bars = (trades(ticks, ts, price)
            .withColumn("_event_time", F.col(ts).cast("timestamp"))
            .withWatermark("_event_time", watermark)
            .groupBy(F.col(symbol).alias("symbol"), F.window(F.col("_event_time"), bar).alias("_w"))
            .agg(*bar_aggregates(ts, price, volume, tiebreak)))
    adj = F.col("close") * F.lit(float(adj_factor)) if adj_factor is not None else F.col("close")
    start = F.col("_w.start").cast("timestamp_ntz") if ntz else F.col("_w.start")
    return bars.select("symbol", start.alias("bar_date"), "open", "high", "low", "close",
                       adj.alias("adj_close"), "volume")
