"""Indicators that go on from a stored state instead of the whole history.

The state of a series is its last bars: as many as any indicator reads back (345 by
default, from the slow EMA), and of the newest one all that the enriched frame has. It
holds all that later bars need: bounded windows read the prices of those bars, an EMA's
older terms weigh below 1e-20 or are the repeated last value, and the latch is the last
bar's position. Of the bars before the newest one nothing else is kept, moved or sorted.
A daily run reads the state and the new bars only; its cost does not grow with the
history. Its result replaces the last stored bar (whose extremum needed the bar after
it) and adds the new ones. States and results are meant to be stored between runs: as
lazy frames, each run's plan would hold the plans of all runs before it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsignals.operators.indicators import DEFAULT, Params
from barsignals.operators.layout import DEFAULT_CARRY_FANOUT
from barsignals.operators.signals import RULES
from barsignals.plans.enrich import (DEFAULT_BLOCK_ROWS, GROUPS, KNOWN, _enrich, _expand, _rules, bars_back,
                                     output_columns)
from barsignals.schema import BAR_COLUMNS, BAR_DATE, SYMBOL, SchemaError, conform_bars

READ_BACK = (SYMBOL, BAR_DATE, "high", "low", "close")  # what later bars read of earlier ones

def series_state(enriched: DataFrame, params: Params = DEFAULT, include: Iterable[str] = GROUPS,
                 rules: Iterable[str] = RULES) -> DataFrame:
    """The last bars of every symbol of an enriched frame with positions (``enrich(..., positions=True)``).

    All columns stay; before a symbol's newest bar those that no later bar reads are NULL
    (so is ``extremum``, which needs the bar after it). The rank limit is applied in every
    map task first, so a symbol costs so many narrow rows per task however long its series
    is; the newest bar is a grouped maximum, dealt out by the same key.
    """
    missing = [f"{r}_position" for r in _rules(rules) if "signals" in set(include) and f"{r}_position" not in enriched.columns]
    if missing:
        raise SchemaError(f"a state needs {missing}: enrich with positions=True")
    latest = Window.partitionBy(SYMBOL).orderBy(F.col(BAR_DATE).desc())
    ranked = enriched.select(*READ_BACK).withColumn("_rank", F.row_number().over(latest))
    ranked = ranked.filter(F.col("_rank") <= bars_back(params, include, rules) + 1)
    unread = [c for c in enriched.columns if c not in READ_BACK and c != "extremum"]
    newest = enriched.groupBy(F.col(SYMBOL).alias("_symbol")).agg(*[F.max_by(c, BAR_DATE).alias(c) for c in unread])
    found = ranked.join(newest, (F.col(SYMBOL) == F.col("_symbol")) & (F.col("_rank") == 1), "left")
    return found.select(*[F.lit(None).cast(enriched.schema[c].dataType).alias(c) if c == "extremum" else F.col(c)
                          for c in enriched.columns])


def resume(state: DataFrame, bars: DataFrame, params: Params = DEFAULT, include: Iterable[str] = GROUPS,
           block_rows: int = DEFAULT_BLOCK_ROWS, segment: str | None = None,
           carry_fanout: int = DEFAULT_CARRY_FANOUT, rules: Iterable[str] = RULES) -> DataFrame:
    """Enriched rows of the new ``bars``, and the last stored bar of each symbol once more.

    ``state`` comes from ``series_state`` with the same ``params``, ``include`` and
    ``rules``; symbols without a state start anew, symbols without new bars keep their
    last bar as it was. New bars must be later than their symbol's state: an earlier
    one raises when the rows are read. The frame has positions, so the next state is
    ``series_state`` of ``advance``. State and new bars go through the layout together,
    once: the newest stored bar is carried along whole, as one value.
    """
    used = _rules(rules) if "signals" in set(include) else ()
    inc = _expand(include, used)
    spans = (params.ema_fast, params.ema_slow) if "ema" in inc else ()
    names = {f"ema{s}": f"{KNOWN}ema{s}" for s in spans} | {f"{r}_position": f"{KNOWN}{r}" for r in used}
    bars = conform_bars(bars)
    extra = [c for c in bars.columns if c not in BAR_COLUMNS]
    columns = [*BAR_COLUMNS, *extra, *output_columns(params, inc, rules)[len(BAR_COLUMNS):], *[f"{r}_position" for r in used]]
    kept = [c for c in columns if c not in READ_BACK and c != "extremum"]
    holds = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in kept], F.lit(False))
    bar = F.when(holds, F.struct(*kept))
    old = state.select(*BAR_COLUMNS, *extra, *[F.col(c).alias(k) for c, k in names.items()], bar.alias(f"{KNOWN}bar"),
                       F.lit(True).alias("_old"))
    types = {f.name: f.dataType for f in old.schema.fields}
    new = bars.select(*BAR_COLUMNS, *extra, *[F.lit(None).cast(types[k]).alias(k) for k in (*names.values(), f"{KNOWN}bar")],
                      F.lit(False).alias("_old"))
    found = _enrich(old.unionByName(new), params, inc, block_rows, segment, carry_fanout, rules, True, known=True)
    if "extrema" not in inc:
        return found.filter(~F.col("_old")).select(*columns)
    # the last stored bar as it was, but for the extremum that its successor decides
    as_it_was = {c: F.when(F.col("_old"), F.col(f"{KNOWN}bar")[c]).otherwise(F.col(c)).alias(c) for c in kept}
    return found.filter(~F.col("_old") | F.col("_newest")).select(*[as_it_was.get(c, F.col(c)) for c in columns])


def advance(stored: DataFrame, resumed: DataFrame) -> DataFrame:
    """Stored rows (a history, or a state) brought up to date by the rows of ``resume``.

    Of a symbol's resumed rows only the first can stand for a stored one (its last bar,
    once more): all others are later than the state. So the stored rows, which are wide
    and many, meet one key per symbol and are not moved.
    """
    first = resumed.groupBy(SYMBOL).agg(F.min(BAR_DATE).alias(BAR_DATE))
    return stored.join(F.broadcast(first), [SYMBOL, BAR_DATE], "left_anti").unionByName(resumed)
