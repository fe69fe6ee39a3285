"""Range, look-back, symbol selection and column selection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the reference's default look-back (today - 60 days .. today).
DEFAULT_LOOKBACK_DAYS = 60


def in_range(df: DataFrame, start=None, end=None, col: str = "bar_date") -> DataFrame:
    """``start <= col < end``; either bound may be None.

    Apply before any window (warm-up, EMA start and latch state then depend on the
    start, as in the reference). Literal bounds push down to the Parquet scan.
    """
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(col) >= _lit(start))
    if end is not None:
        cond = cond & (F.col(col) < _lit(end))
    return df.filter(cond)


def default_range(as_of, days: int = DEFAULT_LOOKBACK_DAYS) -> tuple[dt.date, dt.date]:
    """``(as_of - days, as_of)``. ``as_of`` is an argument, never the wall clock."""
    end = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    if isinstance(end, dt.datetime):
        end = end.date()
    return end - dt.timedelta(days=days), end


def for_symbols(df: DataFrame, symbols, col: str = "symbol") -> DataFrame:
    """Keep the given symbols; an empty selection gives an empty result.

    A Python list becomes an ``IN`` predicate (pushed to the scan); a DataFrame of
    symbols (a watch list of any length) becomes a left-semi join.
    """
    if isinstance(symbols, DataFrame):
        keys = symbols.select(F.col(symbols.columns[0]).alias(col)).distinct()
        return df.join(keys, col, "left_semi")
    values = [symbols] if isinstance(symbols, (str, int)) else list(symbols)
    if not values:
        return df.filter(F.lit(False))
    return df.filter(F.col(col).isin(values))


def select_existing(df: DataFrame, wanted: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """P5: the columns of ``wanted`` that exist, in ``wanted`` order (after ``keep``)."""
    present = set(df.columns)
    return df.select(*keep, *[c for c in wanted if c in present])


def _lit(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(dt.date.fromisoformat(value)) if len(value) == 10 else F.to_timestamp(F.lit(value))
    return F.lit(value)
