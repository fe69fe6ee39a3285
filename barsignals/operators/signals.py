"""buy/sell signals from a two-state latch.

The reference loops over rows with a ``position`` flag: an up-condition while flat
buys, a down-condition while long sells, anything else does nothing and keeps the
state. The state after a row is therefore "the last non-NULL condition was up",
so a loop becomes ``last(state, ignorenulls)`` over the preceding rows: inside a
block by a window, across blocks by ``carry_last``. No UDF, O(n).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barsignals.functions.scalar import crossing_state, is_above, is_below
from barsignals.operators.indicators import DEFAULT, Params, col_names
from barsignals.operators.layout import block_window, own

RULES = ("sma", "ema", "stoch")


def stoch_up(k: Column, d: Column, p: Params = DEFAULT) -> Column:
    """Oversold and %K above %D."""
    return (k < p.stoch_low) & (d < p.stoch_low) & is_above(k, d)


def stoch_down(k: Column, d: Column, p: Params = DEFAULT) -> Column:
    """Overbought and %K below %D."""
    return (k > p.stoch_high) & (d > p.stoch_high) & is_below(k, d)


def condition_columns(p: Params = DEFAULT) -> dict[str, Column]:
    """Per rule: 1 = up-condition, -1 = down-condition, NULL = neither."""
    n = col_names(p)
    k, d = F.col("stoch_k"), F.col("stoch_d")
    return {
        "_s_sma": crossing_state(F.col(n["sma_fast"]), F.col(n["sma_slow"])),
        # NULL where the block has no own EMA value yet: those rows repeat the last
        # carried EMA, hence the last carried condition, which never fires.
        "_s_ema": crossing_state(F.col(n["ema_fast"] + "_local"), F.col(n["ema_slow"] + "_local")),
        "_s_stoch": F.when(stoch_up(k, d, p), F.lit(1)).when(stoch_down(k, d, p), F.lit(-1)),
    }


def condition_stages(p: Params = DEFAULT, rules=RULES, known: bool = False) -> list[dict[str, Column]]:
    """Conditions, then ``_p_<rule>``: the last condition before the row in the block.

    Runs after the indicator stages it reads. ``known``: rows marked ``_old`` have the
    state that the whole series left them in (``_known_<rule>``).
    """
    conds = {k: v for k, v in condition_columns(p).items() if k[3:] in rules}
    if known:
        conds = {k: F.when(F.col("_old"), F.col(f"_known_{k[3:]}")).otherwise(v) for k, v in conds.items()}
    before = block_window().rowsBetween(Window.unboundedPreceding, -1)
    return [conds, {f"_p_{c[3:]}": F.last(own(F.col(c)), True).over(before) for c in conds}]


def state_before(rule: str) -> Column:
    """1 (long) or -1 (flat) before the row, once ``_s_<rule>_carry`` is joined in."""
    return F.coalesce(F.col(f"_p_{rule}"), F.col(f"_s_{rule}_carry"), F.lit(-1))


def position(rule: str) -> Column:
    """1 (long) or -1 (flat) after the row."""
    return F.coalesce(F.col(f"_s_{rule}"), state_before(rule))


def latch_prices(rule: str, price: str = "adj_close") -> dict[str, Column]:
    """buy/sell price columns once ``_s_<rule>_carry`` is joined in.

    State before the row: the last condition in the block, else in earlier blocks,
    else flat (-1). Buy = up while flat, sell = down while long, price = Adj Close.
    """
    s = F.col(f"_s_{rule}")
    prev = state_before(rule)
    return {f"{rule}_buy": F.when((s == 1) & (prev == -1), F.col(price)),
            f"{rule}_sell": F.when((s == -1) & (prev == 1), F.col(price))}
