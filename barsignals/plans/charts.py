"""V2-V9 from bars: each chart computes the indicator groups and rules it draws, no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsignals.functions.scalar import CHART_TITLES, chart_title
from barsignals.operators.charts import LEVEL_CHARTS, chart_columns, chart_series
from barsignals.operators.indicators import DEFAULT, Params
from barsignals.operators.levels import filter_levels, last_levels, local_extrema
from barsignals.plans.enrich import enrich, support_resistance

# Groups of each chart, and its signal rules.
NEEDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "price_overlay": (("sma", "signals"), ("sma", "ema")),
    "sma": (("signals",), ("sma",)),
    "ema": (("signals",), ("ema",)),
    "bollinger": (("sma",), ()),
    "levels": ((), ()),
    "stochastic": (("signals",), ("stoch",)),
    "rsi": (("rsi",), ()),
    "volume": ((), ()),
}


def chart_frame(bars: DataFrame, name: str, params: Params = DEFAULT, **kw) -> DataFrame:
    """The indicators that one figure draws, with the extrema that its level lines come from."""
    include, rules = NEEDS[name]
    if name in LEVEL_CHARTS:
        include = (*include, "extrema")
    return enrich(bars, params, include=include, rules=rules, **kw) if include else bars


def chart(bars: DataFrame, name: str, params: Params = DEFAULT, frame: DataFrame | None = None, **kw) -> DataFrame:
    """One figure's points, tall. Level lines read the bars again (``bars`` should be stored bars), or
    ``frame``: a stored ``chart_frame`` (or any enriched frame with the extrema)."""
    include, rules = NEEDS[name]
    lines = None
    if frame is not None:
        lines = last_levels(filter_levels(local_extrema(frame), params.level_sensitivity)) if name in LEVEL_CHARTS else None
        return chart_series(frame, chart_columns(name, params), lines)
    points = enrich(bars, params, include=include, rules=rules, **kw) if include else bars
    if name in LEVEL_CHARTS:
        lines = support_resistance(bars, params, **kw)
    return chart_series(points, chart_columns(name, params), lines)


def chart_titles(bars: DataFrame) -> DataFrame:
    """F8: (symbol, chart, title) of the five titled charts."""
    pairs = F.array(*[F.struct(F.lit(k).alias("chart"), chart_title("symbol", text).alias("title"))
                      for k, text in CHART_TITLES.items()])
    rows = bars.select("symbol").distinct().select("symbol", F.explode(pairs).alias("t"))
    return rows.select("symbol", "t.chart", "t.title")
