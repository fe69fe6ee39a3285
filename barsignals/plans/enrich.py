"""The enriched frame: bars plus every indicator, signal and extremum flag.

Plan shape (for stored bars): one hash exchange on ``(symbol, segment)`` for row
positions, one on ``(symbol, _blk)`` for all windows, which share one sort. The
cross-block carry reads that exchange again (it is reused, not run again), runs the
windows over the blocks that have later ones, and only moves its one-row-per-block summary. Neither exchange puts more than one block
(``block_rows`` plus halo) of a symbol into a window group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.operators.indicators import (DEFAULT, Params, apply_stages, col_names, ema_stages,
                                             extremum_stages, merge_stages, moving_average_stages,
                                             newest_stages, rsi_stages, stochastic_stages)
from barsignals.operators.layout import (DEFAULT_CARRY_FANOUT, Layout, all_blocks, carry_last, dealt, lay_out, make_layout,
                                          not_last_blocks, own_rows)
from barsignals.operators.levels import filter_levels, last_levels, local_extrema
from barsignals.operators.signals import RULES, condition_stages, latch_prices, position
from barsignals.schema import BAR_COLUMNS, SchemaError, conform_bars

GROUPS = ("sma", "ema", "stochastic", "rsi", "extrema", "signals")
RULE_GROUP = {"sma": "sma", "ema": "ema", "stoch": "stochastic"}
DEFAULT_BLOCK_ROWS = 8192


def output_columns(p: Params = DEFAULT, include: Iterable[str] = GROUPS, rules: Iterable[str] = RULES) -> list[str]:
    """Columns of the enriched frame after any extra columns of the bars."""
    rules = _rules(rules) if "signals" in set(include) else ()
    inc = _expand(include, rules)
    n = col_names(p)
    cols = list(BAR_COLUMNS)
    if "sma" in inc:
        cols += [n["sma_fast"], n["sma_slow"], n["std"], "bb_upper", "bb_lower"]
    if "ema" in inc:
        cols += [n["ema_fast"], n["ema_slow"]]
    if "stochastic" in inc:
        cols += [n["hh"], n["ll"], "stoch_k", "stoch_d"]
    if "rsi" in inc:
        cols += ["rsi"]
    if "extrema" in inc:
        cols += ["extremum"]
    if "signals" in inc:
        cols += [f"{r}_{side}" for r in rules for side in ("buy", "sell")]
    return cols


def _rules(rules: Iterable[str]) -> tuple[str, ...]:
    wanted = set(rules)
    if wanted - set(RULES):
        raise ValueError(f"unknown rules {sorted(wanted - set(RULES))}; use {RULES}")
    return tuple(r for r in RULES if r in wanted)


def _expand(include: Iterable[str], rules: Iterable[str]) -> set[str]:
    inc = set(include)
    unknown = inc - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown indicator groups {sorted(unknown)}; use {GROUPS}")
    if "signals" in inc:  # a rule needs its own indicators only
        inc |= {RULE_GROUP[r] for r in rules}
    return inc


def enrich(bars: DataFrame, params: Params = DEFAULT, include: Iterable[str] = GROUPS,
           block_rows: int = DEFAULT_BLOCK_ROWS, segment: str | None = None,
           carry_fanout: int = DEFAULT_CARRY_FANOUT, rules: Iterable[str] = RULES, positions: bool = False) -> DataFrame:
    """Bars with the requested indicator groups (all by default) and signal ``rules``.

    ``bars`` must already be range- and symbol-filtered (rule Q18); their extra columns
    stay. No job runs here. ``segment`` is the time unit of the position step; it should
    hold at most a few million bars of one symbol. By default ``year`` for DATE bars and
    ``month`` for timestamp bars (use ``day`` for second bars). ``positions`` adds
    ``<rule>_position`` after each bar: 1 (bought) or -1 (flat).
    """
    return _enrich(conform_bars(bars), params, include, block_rows, segment, carry_fanout, rules, positions)


KNOWN = "_known_"


def bars_back(params: Params = DEFAULT, include: Iterable[str] = GROUPS, rules: Iterable[str] = RULES) -> int:
    """Rows before a bar that its indicators read (what a series' state has to hold)."""
    inc = _expand(include, _rules(rules) if "signals" in set(include) else ())
    return max([params.bounded_lookback(), *(params.ema_sub_blocks().values() if "ema" in inc else ())])


def _enrich(bars: DataFrame, params: Params, include: Iterable[str], block_rows: int, segment: str | None,
            carry_fanout: int, rules: Iterable[str], positions: bool, known: bool = False) -> DataFrame:
    """``enrich`` over conformed bars; ``known``: rows marked ``_old`` carry ``_known_*`` results of an earlier run.

    ``_old`` and ``_known_bar`` are then in the result, with ``_newest`` (a symbol's last old row) where there are extrema.
    """
    rules = _rules(rules) if "signals" in set(include) else ()
    inc = _expand(include, rules)
    out_cols = output_columns(params, inc, rules) + [f"{r}_position" for r in rules if positions]
    held = ["_old", *[c for c in bars.columns if c.startswith(KNOWN)]] if known else []
    extra = [c for c in bars.columns if c not in BAR_COLUMNS and c not in held]
    clash = [c for c in extra if c in out_cols or c.startswith("_")]
    if clash:
        raise SchemaError(f"bars have columns that the result uses: {clash}")
    if segment is None:
        segment = "year" if dict(bars.dtypes)["bar_date"] == "date" else "month"
    subs = params.ema_sub_blocks() if "ema" in inc else {}
    layout = make_layout(max([params.bounded_lookback(), *subs.values()]), ahead=1 if "extrema" in inc else 0,
                         block_rows=block_rows, segment=segment,
                         sub=max(subs.values(), default=1), fine=min(subs.values(), default=1))
    laid = dealt(lay_out(bars, layout, "_old" if known else None))
    return _over_blocks(laid, bars.columns, params, inc, rules, carry_fanout, positions, known)


def series_layout(params: Params = DEFAULT, block_rows: int = DEFAULT_BLOCK_ROWS, segment: str = "year") -> Layout:
    """The layout that holds what every indicator group needs."""
    subs = params.ema_sub_blocks()
    return make_layout(max(params.bounded_lookback(), *subs.values()), 1, block_rows, segment, max(subs.values()), min(subs.values()))


def _over_blocks(df: DataFrame, columns: list[str], params: Params, inc: set[str], rules: tuple[str, ...],
                 carry_fanout: int, positions: bool = False, known: bool = False) -> DataFrame:
    """The indicators of laid-out bars, which have ``columns`` besides those of the layout."""
    # a generated method of more bytecode is never compiled by the JVM: beyond that, operators run one by one
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    out_cols = output_columns(params, inc, rules) + [f"{r}_position" for r in rules if positions]
    held = ["_old", *[c for c in columns if c.startswith(KNOWN)]] if known else []
    extra = [c for c in columns if c not in BAR_COLUMNS and c not in held]
    subs = params.ema_sub_blocks() if "ema" in inc else {}
    groups = []
    if "sma" in inc:
        groups.append(moving_average_stages(params))
    if "stochastic" in inc:
        groups.append(stochastic_stages(params))
    if "rsi" in inc:
        groups.append(rsi_stages(params))
    if "extrema" in inc:
        groups.append(extremum_stages())
        if known:
            groups.append(newest_stages())
    if subs:
        groups.append(ema_stages(subs, known=known))
    stages = merge_stages(*groups)
    if rules:
        stages += condition_stages(params, rules, known)
    carried = [f"ema{s}_local" for s in subs] + [f"_s_{r}" for r in rules]
    if carried:
        earlier = own_rows(apply_stages(not_last_blocks(df), stages))
        df = carry_last(own_rows(apply_stages(all_blocks(df), stages)), carried, carry_fanout, pins=columns, earlier=earlier)
    else:
        df = own_rows(apply_stages(df, stages))
    final = {f"ema{s}": F.coalesce(F.col(f"ema{s}_local"), F.col(f"ema{s}_local_carry")) for s in subs}
    for r in rules:
        final.update(latch_prices(r))
        if positions:
            final[f"{r}_position"] = position(r)
    if final:
        df = df.withColumns(final)
    marks = ["_old", f"{KNOWN}bar", *(["_newest"] if "extrema" in inc else [])] if known else []
    return df.select(*BAR_COLUMNS, *extra, *out_cols[len(BAR_COLUMNS):], *marks)


def indicators(bars: DataFrame, params: Params = DEFAULT, **kw) -> DataFrame:
    """W1-W11 only (no signals, no extrema)."""
    return enrich(bars, params, include=("sma", "ema", "stochastic", "rsi"), **kw)


def signals(bars: DataFrame, params: Params = DEFAULT, **kw) -> DataFrame:
    """G1-G3 with the indicators they read."""
    return enrich(bars, params, include=("signals",), **kw)


def extrema(bars: DataFrame, **kw) -> DataFrame:
    """Bars with the ``extremum`` flag only (halo of one row each side)."""
    return enrich(bars, include=("extrema",), **kw)


def levels(bars: DataFrame, params: Params = DEFAULT, **kw) -> DataFrame:
    """L1-L3: filtered support/resistance levels, tall."""
    return filter_levels(local_extrema(extrema(bars, **kw)), params.level_sensitivity)


def support_resistance(bars: DataFrame, params: Params = DEFAULT, **kw) -> DataFrame:
    """A2 over L1-L3: last support and last resistance per symbol."""
    return last_levels(levels(bars, params, **kw))
