"""barsignals: a Spark-native technical-analysis engine over OHLCV price bars."""

from barsignals.operators.filters import default_range, for_symbols, in_range, select_existing
from barsignals.operators.indicators import DEFAULT, Params
from barsignals.operators.charts import chart_columns, chart_series, to_series
from barsignals.operators.levels import filter_levels, last_levels, local_extrema
from barsignals.operators.profile import symbol_profile
from barsignals.operators.snapshot import latest_snapshot
from barsignals.operators.votes import vote_share, votes_long
from barsignals.plans.catalog import register_views
from barsignals.plans.charts import chart, chart_titles
from barsignals.plans.enrich import enrich, extrema, indicators, levels, signals, support_resistance
from barsignals.sources.bars import bars_from_ticks, load_bars
from barsignals.sources.fundamentals import FUNDAMENTALS_SCHEMA, load_fundamentals
from barsignals.sources.sinks import write_enriched
from barsignals.sources.votes import VOTE_LABELS, load_votes, votes_from_tall

__all__ = ["default_range", "for_symbols", "in_range", "select_existing", "DEFAULT", "Params",
           "filter_levels", "last_levels", "local_extrema", "latest_snapshot", "enrich", "extrema",
           "indicators", "levels", "signals", "support_resistance", "bars_from_ticks", "load_bars",
           "FUNDAMENTALS_SCHEMA", "load_fundamentals", "VOTE_LABELS", "load_votes", "votes_from_tall",
           "chart", "chart_columns", "chart_series", "chart_titles", "to_series", "symbol_profile", "vote_share",
           "votes_long", "register_views", "write_enriched"]
