"""Price bars from a table, or built from ticks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsignals.functions.scalar import nan_to_null
from barsignals.operators.filters import for_symbols, in_range
from barsignals.schema import (BAR_DATE, BARS_SCHEMA, SYMBOL, YEAR_COLUMN, SchemaError, conform_bars,
                               duplicate_keys)

DATE_UNITS = ("year", "quarter", "month", "week", "day")
TIME_UNITS = ("hour", "minute", "second")


def load_bars(spark: SparkSession, path: str, fmt: str = "parquet", symbols=None,
              start=None, end=None, schema: T.StructType | None = None,
              options: dict[str, str] | None = None, check_unique: bool = False,
              revision: str | None = None) -> DataFrame:
    """Read stored bars, check the schema, then apply P1/P3 before any window.

    The range and symbol filters are plain predicates on the scan, so Catalyst pushes
    them into the Parquet reader (row-group skipping); where the bars are stored by
    ``bar_year`` (``write_enriched``), the range also selects the years, and the other
    years' files are not listed or opened. A repeated ``(symbol, bar_date)`` (T1) has no
    place in a series: ``check_unique`` rejects it here with one grouped count (a job);
    otherwise the position step raises when the rows are read. ``revision`` names a
    version column by which corrected bars replace earlier ones (``latest_revisions``).
    """
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt in ("csv", "json"):
        reader = reader.schema(schema or BARS_SCHEMA)
        if fmt == "csv":
            reader = reader.option("header", "true")
    elif schema is not None:
        reader = reader.schema(schema)
    bars = conform_bars(reader.load(path))
    if start is not None or end is not None:
        bars = in_range(bars, start, end)
        if YEAR_COLUMN in bars.columns:
            bars = in_years(bars, start, end)
    if symbols is not None:
        bars = for_symbols(bars, symbols)
    if revision is not None:
        bars = latest_revisions(bars, revision)
    elif check_unique:
        dup = duplicate_keys(bars).limit(1).collect()
        if dup:
            raise SchemaError(f"duplicate (symbol, bar_date) in {path}: {dup[0]['symbol']!r}, {dup[0]['bar_date']}")
    return bars


def in_years(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Partitions by year that ``start <= bar_date < end`` can touch (bounds given as values, not columns)."""
    low, high = _as_time(start), _as_time(end)
    year = F.col(YEAR_COLUMN)
    if isinstance(low, dt.date):
        bars = bars.filter(year >= low.year)
    if isinstance(high, dt.date):
        bars = bars.filter(year <= high.year)
    return bars


def latest_revisions(bars: DataFrame, revision: str) -> DataFrame:
    """T1 for corrected bars: of each ``(symbol, bar_date)`` the row of the greatest ``revision``.

    One grouped maximum (one exchange, pre-aggregated: a bar corrected very often costs
    one row per map task). Of rows with one revision the greatest in column order wins,
    so the result is one of the rows as a whole. A bar that comes more than once with a
    missing revision has no order and raises. Columns stay, ``revision`` among them.
    """
    rest = [c for c in bars.columns if c not in (SYMBOL, BAR_DATE, revision)]
    row = F.max(F.struct(revision, *rest))
    unordered = F.raise_error(F.concat(F.lit("a repeated bar has no revision: "), F.col(SYMBOL).cast("string"),
                                       F.lit(", "), F.col(BAR_DATE).cast("string"))).cast("boolean")
    best = bars.groupBy(SYMBOL, BAR_DATE).agg(row.alias("_row"), F.count("*").alias("_n"), F.count(revision).alias("_versions"))
    checked = best.filter(F.when((F.col("_n") > 1) & (F.col("_versions") < F.col("_n")), unordered).otherwise(True))
    return checked.select(*[F.col(c) if c in (SYMBOL, BAR_DATE) else F.col(f"_row.{c}").alias(c) for c in bars.columns])


def bar_key(ts: Column, unit: str, ntz: bool = True) -> Column:
    """Bar start for a tick time: DATE for calendar units, a timestamp below a day.

    Calendar units go through ``to_date``. Sub-day bars of wall-clock (NTZ) times are
    rebuilt from their own fields, so no session time zone (or DST gap) is involved;
    zoned timestamps truncate in the session zone.
    """
    unit = unit.lower()
    if unit == "day":
        return F.to_date(ts)
    if unit in DATE_UNITS:
        return F.trunc(F.to_date(ts), unit)
    if unit in TIME_UNITS:
        if not ntz:
            return F.date_trunc(unit, ts)
        zero = F.lit(0)
        minute = F.minute(ts) if unit in ("minute", "second") else zero
        second = F.floor(F.second(ts)) if unit == "second" else zero
        return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), minute, second)
    raise ValueError(f"unknown bar unit {unit!r}; use one of {DATE_UNITS + TIME_UNITS}")


def next_edge(end: dt.date | dt.datetime, unit: str) -> dt.date | dt.datetime:
    """Start of the first bar at or after ``end``: bars that start before ``end`` have no tick from there on."""
    unit = unit.lower()
    if unit in TIME_UNITS:
        t = end if isinstance(end, dt.datetime) else dt.datetime(end.year, end.month, end.day)
        step = dt.timedelta(**{unit + "s": 1})
        low = t.replace(microsecond=0, **({"second": 0} if unit != "second" else {}),
                        **({"minute": 0} if unit == "hour" else {}))
        return low if low == t else low + step
    day = end.date() if isinstance(end, dt.datetime) else end
    if isinstance(end, dt.datetime) and end.time() != dt.time():
        day += dt.timedelta(days=1)
    if unit == "day":
        return day
    if unit == "week":
        return day + dt.timedelta(days=-day.weekday() % 7)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    at = day.year * 12 + day.month - 1 + (day.day > 1)
    at = -(-at // months) * months
    return dt.date(at // 12, at % 12 + 1, 1)


def _as_time(value) -> dt.date | dt.datetime:
    if isinstance(value, str):
        return dt.date.fromisoformat(value) if len(value) == 10 else dt.datetime.fromisoformat(value)
    return value


def trades(ticks: DataFrame, ts: str, price: str) -> DataFrame:
    """Ticks with a time and a price; a NaN price is none."""
    return ticks.filter(nan_to_null(price).isNotNull() & F.col(ts).isNotNull())


def bar_aggregates(ts: str, price: str, volume: str | None, tiebreak: Sequence[str]) -> list[Column]:
    """open, high, low, close, volume of a group of ticks, in ``(ts, *tiebreak)`` order."""
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    p = F.col(price).cast("double")
    vol = F.sum(nan_to_null(volume)) if volume else F.count(F.lit(1)).cast("double")
    return [F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
            F.max_by(p, order).alias("close"), vol.alias("volume")]


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, price: str, volume: str | None = None,
                    unit: str = "day", tiebreak: Sequence[str] = (),
                    adj_factor: float | None = None, start=None, end=None, symbols=None) -> DataFrame:
    """OHLCV bars from ticks.

    ``open``/``close`` are the first/last price in ``(ts, *tiebreak)`` order, which the
    caller makes unique within a symbol. One hash exchange on ``(symbol, bar)``;
    the map side pre-aggregates, so a hot symbol costs no more than its bar count.
    ``adj_close`` is ``close * adj_factor`` (or ``close``). Ticks without a price
    (NULL or NaN) are not trades and are skipped; missing volume counts ticks.

    ``start <= bar_date < end`` and ``symbols`` (P1, P3) select bars. They reach the
    ticks: the time range, widened to whole bars, is a predicate on the raw tick time,
    which the scan prunes by, and the symbols are selected before the aggregation.
    """
    ticks = trades(ticks, ts, price)
    date_only = dict(ticks.dtypes)[ts] == "date"
    if start is not None:
        ticks = ticks.filter(F.col(ts) >= F.lit(_as_time(start)))
    if end is not None:
        ticks = ticks.filter(F.col(ts) < F.lit(next_edge(_as_time(end), unit)))
    if symbols is not None:
        ticks = for_symbols(ticks, symbols, symbol)
    key = bar_key(F.col(ts), unit, date_only or dict(ticks.dtypes)[ts] != "timestamp")
    bars = ticks.groupBy(F.col(symbol).alias("symbol"), key.alias("bar_date")).agg(
        *bar_aggregates(ts, price, volume, tiebreak))
    if start is not None or end is not None:
        bars = in_range(bars, start, end)
    adj = F.col("close") * F.lit(float(adj_factor)) if adj_factor is not None else F.col("close")
    return bars.select("symbol", "bar_date", "open", "high", "low", "close",
                       adj.alias("adj_close"), "volume")
