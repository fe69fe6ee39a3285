"""What the cost of enrichment may not grow by: second windows, decimal rounding, moved histories."""

import re

from barsignals.operators.layout import dealt, lay_out, make_layout, not_last_blocks
from barsignals.plans import bindings as B
from barsignals.plans.queries import round_double
from barsignals.plans.resume import advance
from paths import SF_SMALL
from pyspark.sql import functions as F


def test_rounding_equals_sparks(spark):
    odd = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.5e-6, 1.005, -1.005, 1e-9, -1e-9, 123456.1234565, 1e6 + 1e-6, 1e15 + 0.5, 1e300,
           float("nan"), float("inf"), float("-inf"), 0.1 + 0.2, 99999.999995, -7.00005, None]
    some = spark.range(20_000).select((F.rand(3) * F.pow(F.lit(10.0), F.rand(4) * 12 - 4) - 50).alias("x"))
    tied = spark.range(5_000).select(((F.col("id") - 2_500) / 16384 * 8).alias("x"))
    df = spark.createDataFrame([(x,) for x in odd], "x double").unionByName(some).unionByName(tied)
    for places in (4, 6):
        x = F.col("x")
        got, want = round_double(x, places), F.round(x, places)
        bits = lambda c: F.hex(c.cast("string").cast("binary"))
        assert df.filter(~bits(got).eqNullSafe(bits(want))).collect() == []


def test_only_blocks_with_later_ones_feed_the_summary(spark):
    bars = B.lineitem_bars(spark, SF_SMALL, "day")
    for rows in (345, 8192):
        laid = dealt(lay_out(bars, make_layout(345, 1, rows, sub=345, fine=115))).cache()
        last = laid.filter("_role = 0").groupBy("symbol").agg(F.max("_blk").alias("last"))
        kept = not_last_blocks(laid).filter("_role = 0").join(last, "symbol")
        want = laid.filter("_role = 0").join(last, "symbol").filter("_blk < last or _t = 0").count()
        assert kept.count() == want and kept.filter("_blk = last and _t > 0").count() == 0
        laid.unpersist()


def test_a_history_is_not_moved(spark, tmp_path):
    B.lineitem_bars(spark, SF_SMALL, "day").write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    plan = re.sub(r"#\d+L?", "", advance(bars, bars.filter("symbol = 1"))._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" not in plan and re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan) == ["symbol"]
