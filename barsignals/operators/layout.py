"""Skew-safe layout of price series for positional window work.

Every indicator of the reference is positional (row ``t`` looks at rows ``t-1``,
``t-14``, ...). Partitioning windows by ``symbol`` alone would put a whole series
into one task, and one symbol may hold a large share of all rows. So a series is
cut into blocks of ``block`` consecutive rows, and each block also receives copies
of the ``back`` rows before it and the ``ahead`` rows after it (halo rows). Windows
then run over ``(symbol, _blk)``: bounded frames are exact at block edges, and
the number of rows per task is bounded by ``block + back + ahead`` whatever the skew.

Positions come from a two-level count: rows per ``(symbol, time segment)`` (a
small table), prefix sums over segments, plus ``row_number`` inside a segment.
Groups are bounded by the segment length, not by the series length.

State that reaches arbitrarily far back (the signal latch, the EMA across NULL
stretches) is carried between blocks by ``carry_last``: a per-block summary, a
two-level scan over that small table, and a join on ``(symbol, _blk)``, by which the
rows are already dealt out.

Internal columns: ``_t`` (0-based row of the series), ``_blk`` (block),
``_role`` (-1 copied from the previous block, 0 own row, 1 copied from the next
block), ``_sub`` and ``_fine`` (the EMA sub-blocks of the long and the short span; a
long one holds whole short ones).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL = "symbol"
BAR_DATE = "bar_date"

# Fixed value: an EMA term older than L rows weighs r**L <= exp(-46) ~ 1e-20
# relative to the newest one, below double precision.
EMA_DECAY_EXPONENT = 46.0


def ema_lookback(span: int) -> int:
    r = 1.0 - 2.0 / (span + 1.0)
    return max(1, math.ceil(EMA_DECAY_EXPONENT / -math.log(r)))


def ema_sub_blocks(spans: Sequence[int]) -> dict[int, int]:
    """Sub-block rows of each span: at least its look-back, and the longest is a multiple of all.

    A short span keeps short sub-blocks however long the other span or the halo is, so
    its weights ``r^-k`` stay far from overflow.
    """
    longest = max(ema_lookback(s) for s in spans)
    parts = {s: longest // ema_lookback(s) for s in spans}
    n = max(parts.values())
    fine = math.ceil(longest / n)
    return {s: fine if parts[s] == n else n * fine for s in spans}


@dataclass(frozen=True)
class Layout:
    back: int
    ahead: int
    block: int
    segment: str
    sub: int
    fine: int


def make_layout(back: int, ahead: int = 1, block_rows: int = 8192, segment: str = "year",
                sub: int = 1, fine: int = 1) -> Layout:
    """``back`` and ``block`` are rounded up to multiples of the sub-block, so these align with blocks."""
    back = math.ceil(max(1, int(back)) / sub) * sub
    block = max(back, math.ceil(int(block_rows) / sub) * sub)
    return Layout(back=back, ahead=int(ahead), block=block, segment=segment, sub=sub, fine=fine)


def block_window() -> Window:
    # Ordered by (_sub, _fine, _t), which is the _t order; sharing the sort key with
    # sub_window() lets all window families run on one sort.
    return Window.partitionBy(SYMBOL, "_blk").orderBy("_sub", "_fine", "_t")


def sub_window(fine: bool = False) -> Window:
    if fine:
        return Window.partitionBy(SYMBOL, "_blk", "_sub", "_fine").orderBy("_t")
    return Window.partitionBy(SYMBOL, "_blk", "_sub").orderBy("_fine", "_t")


def with_position(bars: DataFrame, segment: str = "year", old: str | None = None) -> DataFrame:
    """Add ``_t``: the 0-based row number of each bar within its symbol, by date, and ``_rows``, the symbol's bars.

    A NULL key and a repeated ``(symbol, bar_date)`` (T1) raise an error when the rows
    are read: such rows have no position. ``old`` names a column that is true on the bars
    of a stored state; any other bar that is not later than its symbol's state raises too.
    No check needs a job or a shuffle: the count table also holds where a state ends.
    """
    stop = F.raise_error(F.lit("a bar has no symbol or bar_date"))
    keyed = bars.withColumns({c: F.coalesce(F.col(c), stop.cast(bars.schema[c].dataType)) for c in (SYMBOL, BAR_DATE)})
    keyed = keyed.withColumn("_seg", F.date_trunc(segment, F.col(BAR_DATE)))
    ends = [F.max(F.when(F.col(old), F.col(BAR_DATE))).alias("_end")] if old else []
    counts = keyed.groupBy(SYMBOL, "_seg").agg(F.count(F.lit(1)).alias("_n"), *ends)
    before = Window.partitionBy(SYMBOL).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(SYMBOL, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(SYMBOL)).alias("_rows"),
                            *[F.max("_end").over(Window.partitionBy(SYMBOL)).alias("_end") for _ in ends])
    inside = Window.partitionBy(SYMBOL, "_seg").orderBy(BAR_DATE)
    ranked = keyed.withColumns({"_i": F.row_number().over(inside), "_before": F.lag(BAR_DATE).over(inside)})
    stop_at = lambda text: F.raise_error(F.concat(F.lit(text), F.col(SYMBOL).cast("string"),
                                                  F.lit(", "), F.col(BAR_DATE).cast("string"))).cast("long")
    place = F.when(F.col("_before") == F.col(BAR_DATE), stop_at("duplicate (symbol, bar_date): ")).otherwise(
        (F.col("_off") + F.col("_i") - 1).cast("long"))
    if old:
        late = ~F.col(old) & (F.col(BAR_DATE) <= F.col("_end"))
        place = F.when(late, stop_at("a new bar is not later than the state: ")).otherwise(place)
    return ranked.join(offsets, [SYMBOL, "_seg"]).withColumn("_t", place).drop("_seg", "_i", "_before", "_off", "_end")


def lay_out(bars: DataFrame, layout: Layout, old: str | None = None) -> DataFrame:
    """Position the bars (``old`` as in ``with_position``) and emit each row once per block that needs it."""
    pos = with_position(bars, layout.segment, old)
    t, b = F.col("_t"), F.lit(layout.block)
    copies = [F.lit(0), F.when(t % b >= layout.block - layout.back, F.lit(-1))]
    if layout.ahead:
        copies.append(F.when((t % b < layout.ahead) & (t >= b), F.lit(1)))
    role = F.col("_role")
    more = F.col("_blk") < F.floor((F.col("_rows") - 1) / b)
    # the filter drops nothing: joins on these keys add it to one side only, and readers of
    # one exchange must all have it
    return (pos.withColumn("_role", F.explode(F.array_compact(F.array(*copies))))
            .withColumn("_blk", F.floor(t / b).cast("long") - role)
            .withColumn("_sub", F.floor(t / F.lit(layout.sub)).cast("long"))
            .withColumn("_fine", F.floor(t / F.lit(layout.fine)).cast("long"))
            .withColumn("_more", more).drop("_rows")
            .filter(F.col(SYMBOL).isNotNull() & F.col("_blk").isNotNull()))


def dealt(laid: DataFrame) -> DataFrame:
    """Laid-out bars by block, as every window needs them: one exchange for all that reads them."""
    return laid.repartition(SYMBOL, "_blk")


def above_exchange(cond: Column) -> Column:
    """``cond`` as a filter that stays where it is: moved below the shared exchange, it would make another one."""
    return F.when(F.monotonically_increasing_id() >= 0, cond)


def not_last_blocks(laid: DataFrame) -> DataFrame:
    """Blocks that have a later one in their series: only from these is anything carried.

    Also a series' first bar, which no block reads: an empty side would be planned away, with the shared exchange.
    """
    return laid.filter(above_exchange(F.col("_more") | (F.col("_t") == 0)))


def all_blocks(laid: DataFrame) -> DataFrame:
    """All rows of ``laid``; reads the columns that ``not_last_blocks`` reads."""
    return laid.filter(above_exchange(F.col("_more").isNotNull()))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_role") == 0)


def own(col: Column) -> Column:
    """The value on the block's own rows, NULL on halo copies."""
    return F.when(F.col("_role") == 0, col)


DEFAULT_CARRY_FANOUT = 4096


def _last_before(summary: DataFrame, key: str, cols: Sequence[str], fanout: int, gaps: bool = False) -> DataFrame:
    """``<col>_carry``: the last non-NULL ``<col>_last`` of a smaller ``key`` (same symbol), for each key after one of ``summary``.

    Keys are consecutive, so what holds up to a key is what the next one takes over. With ``gaps`` they need not
    be: ``summary`` has every key, and each gets what holds before it.

    Two levels, so no window group grows with the series: a scan inside groups of
    ``fanout`` keys, and a scan over one summary row per group (``fanout`` times
    fewer rows again). Both tables are small next to the bars.
    """
    grp = F.floor(F.col(key) / F.lit(fanout)).cast("long")
    # dealt out once, for both readers below
    keyed = summary.withColumn("_grp", grp).repartition(SYMBOL, "_grp")
    inner = Window.partitionBy(SYMBOL, "_grp").orderBy(key).rowsBetween(Window.unboundedPreceding, -1 if gaps else 0)
    within = keyed.select(SYMBOL, key, "_grp", *[
        F.last(c + "_last", ignorenulls=True).over(inner).alias(c + "_in") for c in cols])
    groups = keyed.groupBy(SYMBOL, "_grp").agg(*[
        F.max_by(F.col(c + "_last"), F.when(F.col(c + "_last").isNotNull(), F.col(key))).alias(c + "_g")
        for c in cols])
    outer = Window.partitionBy(SYMBOL).orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select(SYMBOL, "_grp", *[
        F.last(c + "_g", ignorenulls=True).over(outer).alias(c + "_out") for c in cols])
    return (within.join(before, [SYMBOL, "_grp"], "left")
            .select(SYMBOL, (F.col(key) + (0 if gaps else 1)).alias(key), *[F.coalesce(F.col(c + "_in"), F.col(c + "_out")).alias(c + "_carry")
                                   for c in cols]))


def carry_last(df: DataFrame, cols: Sequence[str], fanout: int = DEFAULT_CARRY_FANOUT,
               pins: Sequence[str] = (), earlier: DataFrame | None = None) -> DataFrame:
    """For each column add ``<col>_carry``: its last non-NULL value in earlier blocks.

    ``df`` holds own rows only, after the windows. ``earlier`` holds the same for the
    blocks that have later ones (``not_last_blocks``) and feeds the summary, so a series
    of one block runs its windows once; by default that is ``df``. The summary keeps
    every input column alive up to the shared ``(symbol, _blk)`` exchange (``pins``), so
    both readers have the same exchange and Spark runs it once; nothing is stored and no
    job runs here. The summary has one row per block and is scanned in two levels
    (``_last_before``). It is joined on the key by which ``df`` is already dealt out and
    sorted, so that join moves only the summary, whatever its size.
    """
    first = cols[0]
    last = {c: F.max_by(F.struct(F.col(c).alias("v"), *([F.col(x) for x in pins] if c == first else [])),
                        F.when(F.col(c).isNotNull(), F.col("_t"))) for c in cols}
    read = df if earlier is None else earlier
    summary = read.groupBy(SYMBOL, "_blk").agg(*[agg.alias(c + "_last") for c, agg in last.items()])
    summary = summary.select(SYMBOL, "_blk", *[F.col(c + "_last.v").alias(c + "_last") for c in cols])
    return df.join(_last_before(summary, "_blk", cols, fanout), [SYMBOL, "_blk"], "left")
