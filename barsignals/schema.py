"""Canonical bar schema and the load-time checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsignals.functions.scalar import nan_to_null

SYMBOL = "symbol"
BAR_DATE = "bar_date"
YEAR_COLUMN = "bar_year"  # the partition column of stored bars
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]
BAR_COLUMNS = [SYMBOL, BAR_DATE, *PRICE_COLUMNS]

# Reading CSV (or any source without a schema) uses this; Parquet keeps its own
# key types, since any key type works as ``symbol``.
BARS_SCHEMA = T.StructType([
    T.StructField(SYMBOL, T.StringType(), False),
    T.StructField(BAR_DATE, T.DateType(), False),
    *[T.StructField(c, T.DoubleType(), True) for c in PRICE_COLUMNS],
])


class SchemaError(ValueError):
    pass


def conform_bars(df: DataFrame) -> DataFrame:
    """Check the required columns, cast prices to double and turn NaN into NULL.

    ``open`` and ``volume`` may be absent (the reference never reads ``open``);
    they are added as NULL. ``adj_close`` falls back to ``close`` when absent.
    ``symbol`` and ``bar_date`` are keys and must be non-NULL: a row without them
    has no place in a series, so the enrichment does not return it.
    """
    cols = set(df.columns)
    missing = [c for c in (SYMBOL, BAR_DATE, "high", "low", "close") if c not in cols]
    if missing:
        raise SchemaError(f"bars are missing columns {missing}; have {sorted(cols)}")
    date_type = df.schema[BAR_DATE].dataType
    if not isinstance(date_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise SchemaError(f"bar_date must be DATE or TIMESTAMP, got {date_type.simpleString()}")
    price = {}
    for c in PRICE_COLUMNS:
        if c in cols:
            price[c] = nan_to_null(c)
        elif c == "adj_close":
            price[c] = nan_to_null("close")
        else:
            price[c] = F.lit(None).cast("double")
    extra = [c for c in df.columns if c not in BAR_COLUMNS]
    return df.select(SYMBOL, BAR_DATE, *[price[c].alias(c) for c in PRICE_COLUMNS], *extra)


def duplicate_keys(bars: DataFrame) -> DataFrame:
    """Rows of ``(symbol, bar_date)`` that occur more than once (T1: must be empty)."""
    return (bars.groupBy(SYMBOL, BAR_DATE).count().filter(F.col("count") > 1))
