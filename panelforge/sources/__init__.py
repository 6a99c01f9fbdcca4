"""Sources, sinks and shaping."""

from panelforge.sources.io import (  # noqa: F401
    BAR_SCHEMA, conform_bars, load_bars, to_wide, wide_to_long, tag, union_panel,
    sort_panel, panel_profile, write_stage, read_or_build,
)
from panelforge.sources.bars import (  # noqa: F401
    ohlcv_bars, trade_ticks, stock_bars, stock_panel, benchmark_series, event_bars,
    BENCHMARKS,
)
