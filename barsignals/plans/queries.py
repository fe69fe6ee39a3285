"""

Each takes ``(spark, sf_dir)`` and returns a DataFrame. Every computed double is
rounded as in the oracle SQL, so values hash alike: to ``DECIMALS`` places, and to
``LOOSE_DECIMALS`` where the sum of an average or deviation of large prices has no
fixed order (``LOOSE``): there the last bits differ between any two engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barsignals.functions.scalar import symbol_base
from barsignals.operators.asof import as_of
from barsignals.operators.filters import default_range
from barsignals.operators.indicators import Params
from barsignals.operators.levels import filter_levels, last_levels, level_clusters, local_extrema
from barsignals.operators.profile import symbol_profile
from barsignals.operators.snapshot import latest_snapshot
from barsignals.operators.votes import vote_share
from barsignals.plans import bindings as B
from barsignals.plans.catalog import recent_bars, register_functions, register_views
from barsignals.plans.charts import LEVEL_CHARTS, chart, chart_frame, chart_titles
from barsignals.plans.enrich import enrich, extrema, levels, support_resistance
from barsignals.plans.resume import advance, resume, series_state
from barsignals.sources.bars import load_bars
from barsignals.sources.blocks import enrich_blocks, write_blocks
from barsignals.sources.sinks import write_enriched
from barsignals.staging import staged, staging_path, unstaged

DECIMALS = 6
LOOSE_DECIMALS = 4
LOOSE = ("std", "bb_", "ema")
LONG_EMA = Params(ema_fast=5, ema_slow=100)
BAND = Params(level_sensitivity=0.6)  # wide enough that some levels drop
FINE_PRICE = 0.125  # prices times this have three decimals, many of them ties
RECENT_AS_OF = "1999-01-01"
CLUSTER_GAP = 0.002
RESUME_AT = ("1997-07-01", "1998-02-10")

# The ad-hoc question, as SQL text over the registered view.
ADHOC_SQL = """SELECT symbol, count(*) AS n_bars, round(avg(rsi), 4) AS avg_rsi,
       count(sma_buy) AS sma_buys, count(sma_sell) AS sma_sells,
       count(stoch_buy) AS stoch_buys, round(max(stoch_k), 4) AS max_k
FROM bars_enriched GROUP BY symbol"""


# Another one, with indicators that the enriched frame does not hold.
FUNCTION_SQL = """SELECT symbol, bar_date, bar_sma(closes, 7) AS sma7, bar_std(closes, 7) AS std7, bar_ema(closes, 9) AS ema9,
       bar_rsi(closes, 14) AS rsi14, bar_stoch_k(closes, highs, lows, 9) AS k9,
       bar_cross(bar_sma(closes, 3), bar_sma(closes, 7)) AS crossing
FROM bars_recent"""


def decimals(name: str) -> int:
    return LOOSE_DECIMALS if name.startswith(LOOSE) and not name.endswith(("_buy", "_sell", "_price")) else DECIMALS


def round_double(x: Column, places: int) -> Column:
    """``F.round`` of a double, without its decimal arithmetic where that can't matter.

    Scaled to an integer below 2**40, the error is far less than the distance kept from a
    tie; the quotient of two whole numbers is the double nearest to the decimal. Ties,
    large values, NaN and NULL go the long way.
    """
    scaled = x * 10.0 ** places
    clear = (F.abs(scaled) < float(1 << 40)) & (F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) > 0.01)
    return F.when(clear, F.rint(scaled) / 10.0 ** places + 0.0).otherwise(F.round(x, places))


def rounded(df: DataFrame) -> DataFrame:
    cols = [round_double(F.col(f.name), decimals(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def rounded_series(df: DataFrame) -> DataFrame:
    loose = F.lit(False)
    for prefix in LOOSE:
        loose = loose | F.col("series").startswith(prefix)
    loose = loose & ~F.col("series").rlike("_(buy|sell)$")
    return df.withColumn("value", F.when(loose, F.round("value", LOOSE_DECIMALS)).otherwise(F.round("value", DECIMALS)))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return B.lineitem_bars(spark, sf, "month")


def stored(bars: DataFrame) -> DataFrame:
    """Bars built from ticks, written once as a deployment stores its bars: the position
    step and level lines read their input again, and that is then not another scan of the ticks."""
    return staged(bars, "bars")


def _cols(df: DataFrame, *cols: str) -> DataFrame:
    return rounded(df.select("symbol", "bar_date", *cols))


def _fired(df: DataFrame, rule: str) -> DataFrame:
    buy, sell = f"{rule}_buy", f"{rule}_sell"
    return _cols(df.filter(F.col(buy).isNotNull() | F.col(sell).isNotNull()), buy, sell)


def q_bars_month(spark, sf):
    return rounded(monthly(spark, sf))


def q_bars_day(spark, sf):
    return rounded(B.lineitem_bars(spark, sf, "day"))


def q_bars_events_hour(spark, sf):
    return rounded(B.event_bars(spark, sf, "hour"))


def q_bars_range(spark, sf):
    return rounded(B.lineitem_bars(spark, sf, "month", B.RANGE_START, B.RANGE_END, B.watchlist(spark, sf)))


def q_recent_window(spark, sf):
    start, end = default_range(RECENT_AS_OF)
    bars = B.lineitem_bars(spark, sf, "day", start, end)
    return _cols(enrich(stored(bars), include=("sma", "rsi")), "close", "sma5", "rsi")


def q_sma(spark, sf):
    return _cols(enrich(stored(monthly(spark, sf)), include=("sma",)), "sma5", "sma15")


def q_bollinger(spark, sf):
    return _cols(enrich(stored(monthly(spark, sf)), include=("sma",)), "std15", "bb_upper", "bb_lower")


def q_ema(spark, sf):
    return _cols(enrich(stored(monthly(spark, sf)), include=("ema",)), "ema5", "ema15")


def q_stochastic(spark, sf):
    return _cols(enrich(stored(monthly(spark, sf)), include=("stochastic",)), "hh5", "ll5", "stoch_k", "stoch_d")


def q_rsi(spark, sf):
    return _cols(enrich(stored(monthly(spark, sf)), include=("rsi",)), "rsi")


def q_sma_signals(spark, sf):
    return _fired(enrich(stored(monthly(spark, sf)), include=("signals",), rules=("sma",)), "sma")


def q_ema_signals(spark, sf):
    return _fired(enrich(stored(monthly(spark, sf)), include=("signals",), rules=("ema",)), "ema")


def q_stochastic_signals(spark, sf):
    return _fired(enrich(stored(monthly(spark, sf)), include=("signals",), rules=("stoch",)), "stoch")


def q_extrema(spark, sf):
    return rounded(local_extrema(extrema(stored(monthly(spark, sf)))))


def q_levels(spark, sf):
    return rounded(levels(stored(monthly(spark, sf))))


def q_last_levels(spark, sf):
    return rounded(support_resistance(stored(monthly(spark, sf))))


def q_latest_snapshot(spark, sf):
    return rounded(latest_snapshot(monthly(spark, sf)))


def q_vote_share(spark, sf):
    return rounded(vote_share(B.event_votes(spark, sf)))


def q_fundamentals(spark, sf):
    return rounded(B.event_fundamentals(spark, sf))


def q_symbol_base(spark, sf):
    s = B.table(spark, sf, "supplier")
    ticker = F.concat(F.col("s_suppkey").cast("string"), F.lit(".NS"))
    named = F.concat(F.col("s_name"), F.lit(".BO.X"))
    return s.select("s_suppkey", ticker.alias("ticker"), symbol_base(ticker).alias("base"),
                    symbol_base(named).alias("name_base"))


def _chart(name: str):
    def query(spark, sf):
        bars = stored(monthly(spark, sf))
        frame = staged(chart_frame(bars, name), "enriched") if name in LEVEL_CHARTS else None  # read by points and lines
        return rounded_series(chart(bars, name, frame=frame))
    return query


def q_volume_chart(spark, sf):
    return rounded_series(chart(monthly(spark, sf), "volume"))


def q_chart_titles(spark, sf):
    return chart_titles(monthly(spark, sf))


def q_symbol_profile(spark, sf):
    # stored once, for the last values and for the levels: one layout and one run of the windows
    frame = staged(enrich(stored(monthly(spark, sf))), "enriched")
    levels_of = last_levels(filter_levels(local_extrema(frame)))
    return rounded(symbol_profile(frame, levels_of, B.supplier_fundamentals(spark, sf), B.event_votes(spark, sf)))


def q_signals_daily(spark, sf):
    out = enrich(stored(B.lineitem_bars(spark, sf, "day")), include=("signals",))
    return _cols(out, *[f"{r}_{side}" for r in ("sma", "ema", "stoch") for side in ("buy", "sell")])


def q_levels_daily(spark, sf):
    return rounded(levels(stored(B.lineitem_bars(spark, sf, "day"))))


def q_enriched_blocks(spark, sf):
    """Daily bars in blocks of 345 rows: halo rows, sub-block hand-over and the carry all take part."""
    return rounded(enrich(stored(B.lineitem_bars(spark, sf, "day")), block_rows=345, carry_fanout=1))


def q_ema_long(spark, sf):
    return _cols(enrich(stored(B.event_bars(spark, sf, "minute")), LONG_EMA, include=("ema",)), "ema5", "ema100")


def q_levels_band(spark, sf):
    return rounded(levels(stored(monthly(spark, sf)), BAND))


def q_fundamentals_full(spark, sf):
    return rounded(B.supplier_documents(spark, sf))


def q_snapshot_rounded(spark, sf):
    bars = monthly(spark, sf)
    return rounded(latest_snapshot(bars.withColumns({c: F.col(c) * FINE_PRICE for c in ("close", "high", "low")})))


def q_load_roundtrip(spark, sf):
    """S5 then S1: enriched daily bars written by year, one range and watch list read back and enriched anew."""
    path = staging_path(spark, "roundtrip")
    write_enriched(B.lineitem_bars(spark, sf, "day"), path)
    bars = load_bars(spark, path, symbols=B.watchlist(spark, sf), start=B.RANGE_START, end=B.RANGE_END)
    return _cols(enrich(bars, include=("sma", "rsi")), "close", "volume", "sma15", "rsi")


def q_bars_revised(spark, sf):
    """Corrected bars stored by year, a range of them read back in their latest revision."""
    path = staging_path(spark, "revisions")
    write_enriched(B.revised_bars(spark, sf), path)
    bars = load_bars(spark, path, start=B.RANGE_START, end=B.RANGE_END, revision="revision")
    return _cols(enrich(stored(bars), include=("sma",)), "revision", "high", "close", "adj_close", "sma5")


def q_fundamentals_any(spark, sf):
    return rounded(B.supplier_any_documents(spark, sf))


def q_bars_as_of(spark, sf):
    """J3 at a point in time: each daily bar with the latest report up to its day."""
    bars = B.lineitem_bars(spark, sf, "day").select("symbol", "bar_date", "close", "volume")
    return rounded(as_of(bars, B.order_reports(spark, sf), ["revenue", "status"], at="reported"))


def q_level_clusters(spark, sf):
    return rounded(level_clusters(local_extrema(extrema(stored(B.lineitem_bars(spark, sf, "day")))), CLUSTER_GAP))


def q_adhoc_functions(spark, sf):
    """A question that calls indicators with spans of its own."""
    register_functions(spark)
    register_views(recent_bars(stored(monthly(spark, sf)), 120), "bars_recent")
    return rounded(spark.sql(FUNCTION_SQL))


def q_adhoc_sql(spark, sf):
    register_views(enrich(stored(monthly(spark, sf))), "bars_enriched")
    return spark.sql(ADHOC_SQL)


def q_enriched(spark, sf):
    return rounded(enrich(stored(monthly(spark, sf))))


def q_enriched_daily(spark, sf):
    return rounded(enrich(stored(B.lineitem_bars(spark, sf, "day"))))


def q_enriched_bucketed(spark, sf):
    """Daily bars stored by symbol and block, enriched without moving them."""
    table = f"bars_by_block_{uuid.uuid4().hex}"
    write_blocks(stored(B.lineitem_bars(spark, sf, "day")), table, 16, block_rows=690, path=staging_path(spark, "blocks"))
    return rounded(enrich_blocks(spark, table))


def q_enriched_resumed(spark, sf):
    """Daily bars up to a day, then two later deliveries, each from the state that the run before it left.

    Bars are stored as each delivery comes, and go when its results are; a state goes when the next one is stored.
    """
    bars = stored(B.lineitem_bars(spark, sf, "day", end=RESUME_AT[0]))
    history = staged(enrich(bars, positions=True), "history")
    unstaged(bars)
    state = staged(series_state(history), "state")
    for start, end in zip(RESUME_AT, [*RESUME_AT[1:], None]):
        bars = stored(B.lineitem_bars(spark, sf, "day", start, end))
        out = staged(resume(state, bars), "resumed")
        unstaged(bars)
        before, state = state, staged(series_state(advance(state, out)), "state")
        unstaged(before)
        history = advance(history, out)
    return rounded(history.drop("sma_position", "ema_position", "stoch_position"))


def q_enriched_events(spark, sf):
    return rounded(enrich(stored(B.event_bars(spark, sf, "hour"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars_month": q_bars_month,
    "bars_day": q_bars_day,
    "bars_events_hour": q_bars_events_hour,
    "bars_range": q_bars_range,
    "recent_window": q_recent_window,
    "sma": q_sma,
    "bollinger": q_bollinger,
    "ema": q_ema,
    "stochastic": q_stochastic,
    "rsi": q_rsi,
    "sma_signals": q_sma_signals,
    "ema_signals": q_ema_signals,
    "stochastic_signals": q_stochastic_signals,
    "extrema": q_extrema,
    "levels": q_levels,
    "last_levels": q_last_levels,
    "latest_snapshot": q_latest_snapshot,
    "vote_share": q_vote_share,
    "fundamentals": q_fundamentals,
    "symbol_base": q_symbol_base,
    "price_overlay": _chart("price_overlay"),
    "sma_chart": _chart("sma"),
    "ema_chart": _chart("ema"),
    "bollinger_chart": _chart("bollinger"),
    "level_chart": _chart("levels"),
    "stochastic_chart": _chart("stochastic"),
    "rsi_chart": _chart("rsi"),
    "volume_chart": q_volume_chart,
    "chart_titles": q_chart_titles,
    "symbol_profile": q_symbol_profile,
    "adhoc_sql": q_adhoc_sql,
    "enriched": q_enriched,
    "enriched_daily": q_enriched_daily,
    "enriched_events": q_enriched_events,
    "enriched_blocks": q_enriched_blocks,
    "enriched_bucketed": q_enriched_bucketed,
    "enriched_resumed": q_enriched_resumed,
    "signals_daily": q_signals_daily,
    "levels_daily": q_levels_daily,
    "levels_band": q_levels_band,
    "ema_long": q_ema_long,
    "fundamentals_full": q_fundamentals_full,
    "snapshot_rounded": q_snapshot_rounded,
    "load_roundtrip": q_load_roundtrip,
    "bars_revised": q_bars_revised,
    "fundamentals_any": q_fundamentals_any,
    "bars_as_of": q_bars_as_of,
    "level_clusters": q_level_clusters,
    "adhoc_functions": q_adhoc_functions,
}
