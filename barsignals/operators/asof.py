"""J3 at a point in time: each bar with the latest dated fact of its symbol.

Facts (fundamentals, vote counts) and bars are put on one time line per symbol and cut
into time segments; a window inside a segment finds the last fact, and the last fact of
earlier segments is carried by a scan over one row per segment. There is no range join,
and no window group outgrows a segment, however long or hot a symbol's series is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsignals.operators.layout import BAR_DATE, DEFAULT_CARRY_FANOUT, SYMBOL, _last_before
from barsignals.schema import SchemaError

SEGMENTS = {"year": lambda t: F.year(t), "month": lambda t: F.year(t) * 12 + F.month(t), "day": lambda t: F.unix_date(F.to_date(t))}


def as_of(bars: DataFrame, facts: DataFrame, columns: Sequence[str], at: str = "as_of", segment: str = "year",
          fanout: int = DEFAULT_CARRY_FANOUT) -> DataFrame:
    """``bars`` with ``at`` and ``columns`` of the latest fact at or before each bar (NULL: none yet).

    ``facts`` has the symbol, the time ``at`` (of the bars' type) and ``columns``. A fact
    counts as a row: its NULLs hide earlier values. Of facts of one time the greatest in
    column order counts. Facts without symbol or time count for nothing; bars without
    them keep their row, without a fact.
    """
    if segment not in SEGMENTS:
        raise ValueError(f"unknown segment {segment!r}; use one of {sorted(SEGMENTS)}")
    clash = [c for c in (at, *columns) if c in bars.columns]
    if clash:
        raise SchemaError(f"bars already have columns {clash}")
    fact = F.struct(F.col(at), *columns)
    kept = [c for c in bars.columns if c not in (SYMBOL, BAR_DATE)]
    row = F.struct(*kept) if kept else F.struct(F.lit(1).alias("_one"))
    times = facts.filter(F.col(SYMBOL).isNotNull() & F.col(at).isNotNull())
    kind = dict(bars.dtypes)[BAR_DATE]
    left = bars.select(SYMBOL, BAR_DATE, row.alias("_row"))
    right = times.select(F.col(SYMBOL).cast(dict(bars.dtypes)[SYMBOL]).alias(SYMBOL), F.col(at).cast(kind).alias(BAR_DATE), fact.alias("_fact"))
    line = left.unionByName(right, allowMissingColumns=True).withColumn("_seg", SEGMENTS[segment](F.col(BAR_DATE)).cast("long"))
    # facts of one time before its bars, the greatest last
    order = [F.col(BAR_DATE), F.col("_row").isNotNull(), F.col("_fact")]
    seen = Window.partitionBy(SYMBOL, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = line.repartition(SYMBOL, "_seg")  # dealt out once, for both readers below
    here = line.withColumn("_here", F.last("_fact", ignorenulls=True).over(seen))
    summary = line.filter(F.col("_fact").isNotNull()).groupBy(SYMBOL, "_seg").agg(F.max(F.struct(BAR_DATE, "_fact")).alias("_m"))
    segments = line.groupBy(SYMBOL, "_seg").agg(F.count("*").alias("_n")).join(summary, [SYMBOL, "_seg"], "left")
    carried = _last_before(segments.select(SYMBOL, "_seg", F.col("_m._fact").alias("_fact_last")), "_seg", ["_fact"], fanout, gaps=True)
    out = here.filter(F.col("_row").isNotNull()).join(carried, [SYMBOL, "_seg"], "left")
    best = F.coalesce("_here", "_fact_carry")
    return out.withColumn("_best", best).select(SYMBOL, BAR_DATE, *[F.col(f"_row.{c}").alias(c) for c in kept],
                                                *[F.col(f"_best.{c}").alias(c) for c in (at, *columns)])
