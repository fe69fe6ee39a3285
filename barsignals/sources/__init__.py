from barsignals.sources.bars import bar_key, bars_from_ticks, latest_revisions, load_bars
from barsignals.sources.fundamentals import FUNDAMENTALS_SCHEMA, load_any_document, load_fundamentals
from barsignals.sources.sinks import write_enriched
from barsignals.sources.votes import VOTE_LABELS, load_votes, votes_from_tall

__all__ = ["bar_key", "bars_from_ticks", "latest_revisions", "load_bars", "FUNDAMENTALS_SCHEMA",
           "load_any_document", "load_fundamentals",
           "write_enriched", "VOTE_LABELS", "load_votes", "votes_from_tall"]
