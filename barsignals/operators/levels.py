"""L1-L3, A2: support / resistance levels.

``levels`` is a tall table ``(symbol, kind, bar_date, level)``; the date is kept
so "last" means last in time (rule Q15).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsignals.operators.indicators import DEFAULT


def local_extrema(enriched: DataFrame) -> DataFrame:
    """L1/L2: rows whose close is a strict local minimum (support) or maximum (resistance).

    Takes a frame with an ``extremum`` column (``plans.enrich.extrema`` or
    ``plans.enrich.enrich``); levels come from ``close`` (rule Q16).
    """
    return (enriched.filter(F.col("extremum").isNotNull())
            .select("symbol", F.col("extremum").alias("kind"), "bar_date", F.col("close").alias("level")))


def filter_levels(levels: DataFrame, sensitivity: float = DEFAULT.level_sensitivity) -> DataFrame:
    """L3 (rule Q14): keep a level if some level of the same kind is more than
    ``sensitivity * level`` away.

    The furthest other level is the group's max or min, so the pairwise test is
    exact as ``max - level > s*level or level - min > s*level``: O(m), no self-join.
    The min/max come from a grouped aggregation (pre-aggregated before its shuffle,
    so a symbol with most of the levels costs one row per map task) and are joined
    back; adaptive execution broadcasts that small table when it measures small,
    and splits a skewed partition otherwise. The bounds read the date too, so both
    sides need the same columns of the windows' exchange and share it.
    """
    point = F.struct("level", "bar_date")
    bounds = levels.groupBy("symbol", "kind").agg(F.max(point).alias("_max"), F.min(point).alias("_min"))
    bounds = bounds.select("symbol", "kind", F.col("_max.level").alias("_hi"), F.col("_min.level").alias("_lo"))
    s = F.lit(float(sensitivity))
    lv = F.col("level")
    keep = ((F.col("_hi") - lv) > s * lv) | ((lv - F.col("_lo")) > s * lv)
    return levels.join(bounds, ["symbol", "kind"]).filter(keep).drop("_hi", "_lo")


def last_levels(levels: DataFrame) -> DataFrame:
    """The chronologically last surviving level per symbol and kind."""
    return levels.groupBy("symbol", "kind").agg(
        F.max_by("level", "bar_date").alias("level"), F.max("bar_date").alias("bar_date"))


def level_clusters(levels: DataFrame, tolerance: float = DEFAULT.level_sensitivity) -> DataFrame:
    """Levels that lie close together, as one row each: (symbol, kind, cluster, low, high, mean, hits, first_date, last_date).

    Sorted by price, a level further than ``tolerance * |previous level|`` above the one
    before it starts a new cluster; clusters are numbered upwards from 0, and ``hits`` is
    how many bars turned there. Prices are first grouped into cells half as wide as the
    tolerance, whose levels always belong together, with map-side partial aggregation;
    only one row per cell is sorted, so a window group holds as many rows as the price
    range has cells (some hundreds), whatever the number of bars. NULL levels count for
    nothing.
    """
    if not tolerance > 0:
        raise ValueError("the tolerance must be positive")
    lv = F.col("level")
    width = math.log1p(tolerance) / 2
    # NULL for a level of zero, which is a cell of its own
    cell = F.floor(F.ln(F.when(lv != 0, F.abs(lv))) / F.lit(width))
    cells = levels.filter(lv.isNotNull()).groupBy("symbol", "kind", F.signum(lv).alias("_sign"), cell.alias("_cell")).agg(
        F.min(lv).alias("low"), F.max(lv).alias("high"), F.sum(lv).alias("_sum"), F.count(lv).alias("hits"),
        F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"))
    upwards = Window.partitionBy("symbol", "kind").orderBy("low")
    before = F.lag("high").over(upwards)
    fresh = F.when(F.col("low") - before > F.lit(float(tolerance)) * F.abs(before), 1).otherwise(0)
    marked = cells.withColumn("_fresh", fresh).withColumn("cluster", F.sum("_fresh").over(upwards))
    return marked.groupBy("symbol", "kind", "cluster").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("_sum") / F.sum("hits")).alias("mean"), F.sum("hits").alias("hits"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
