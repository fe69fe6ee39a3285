"""S2 on a stream equals the batch bars for every bar the watermark has closed."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from barsignals.plans.bindings import ADJ_FACTOR, event_bars
from barsignals.streaming import stream_bars
from paths import SF_SMALL


def test_stream_bars_match_batch(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    shutil.copy(f"{SF_SMALL}/events.parquet", feed / "part-0.parquet")
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    bars = stream_bars(src, "event_type", "ts", "value", None, bar="1 hour", watermark="0 seconds",
                       tiebreak=("event_id",), adj_factor=ADJ_FACTOR)
    q = (bars.writeStream.outputMode("append").format("memory").queryName("stream_bars_test")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("stream_bars_test")
    batch = event_bars(spark, SF_SMALL, "hour")
    last = batch.agg(F.max("bar_date")).first()[0]
    want = {tuple(r) for r in batch.filter(F.col("bar_date") < last).collect()}
    have = {tuple(r) for r in got.collect()}
    assert want and want == have


def test_wall_clock_ticks_need_utc(spark):
    src = spark.readStream.schema("s string, ts timestamp_ntz, p double").parquet(SF_SMALL)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            stream_bars(src, "s", "ts", "p")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
