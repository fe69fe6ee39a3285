"""Scalar column helpers (F1-F8 of the inventory).

All of them are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two doubles closer than this (relative) count as equal when a fast
# average is compared with a slow one, or %K with %D. Without it, flat prices give
# false crossings from last-bit rounding.
TIE_RTOL = 1e-9


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_double() -> Column:
    """the missing value of a double column (NULL, never NaN)."""
    return F.lit(None).cast("double")


def nan_to_null(col: Column | str) -> Column:
    """NaN becomes NULL: Spark counts NaN as a value and sorts it above numbers."""
    c = _c(col).cast("double")
    return F.nanvl(c, null_double())


def symbol_base(col: Column | str) -> Column:
    """text before the first dot (``ACME.NS`` -> ``ACME``)."""
    return F.substring_index(_c(col).cast("string"), ".", 1)


def round2(col: Column | str) -> Column:
    """two decimals as numpy rounds: the double times 100 to the nearest integer, ties to even."""
    return F.rint(_c(col) * 100) / 100


def safe_div(num: Column, den: Column) -> Column:
    """division that yields NULL on a zero divisor (ANSI ``/`` raises)."""
    return F.try_divide(num, den)


def tie(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(TIE_RTOL) * F.greatest(F.abs(a), F.abs(b))


def is_above(a: Column, b: Column) -> Column:
    """``a > b`` that is false on a tolerance tie; NULL when either side is NULL."""
    return (a > b) & ~tie(a, b)


def is_below(a: Column, b: Column) -> Column:
    return (a < b) & ~tie(a, b)


def crossing_state(fast: Column, slow: Column) -> Column:
    """1 when fast is above slow, -1 when below, NULL on a tie or a NULL input."""
    return F.when(is_above(fast, slow), F.lit(1)).when(is_below(fast, slow), F.lit(-1))


# The texts that follow the symbol in the titles of the five price charts.
CHART_TITLES = {
    "price_overlay": "Price History with buy and sell signals",
    "sma": "Price History with Buy and Sell Signals (SMA)",
    "ema": "Price History with Buy and Sell Signals (EMA)",
    "bollinger": "Price History with Bollinger Bands",
    "levels": "Price History with Support-Resistance levels",
}


def chart_title(symbol: Column | str, text: str) -> Column:
    """F8: chart title such as ``<symbol> Price History with Bollinger Bands``."""
    return F.concat(_c(symbol).cast("string"), F.lit(" " + text))


def vote_chart_title(symbol: Column | str, exchange: Column | str, interval: Column | str) -> Column:
    """F8: title of the vote shares, from the symbol without its exchange suffix, the exchange and the vote interval."""
    # fixed value: the words between them
    return F.concat(F.lit("Recommendations for "), symbol_base(symbol), F.lit(" on "), _c(exchange), F.lit(" - "), _c(interval))
