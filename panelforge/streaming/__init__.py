"""Structured Streaming form of the bar builder."""

from panelforge.streaming.bars import stream_bars, trade_stream, write_bars  # noqa: F401
