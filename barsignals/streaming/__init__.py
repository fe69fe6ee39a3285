"""Streaming entry points. The reference itself has no streaming; this is S2 on a tick stream."""

from barsignals.streaming.bars import stream_bars

__all__ = ["stream_bars"]
