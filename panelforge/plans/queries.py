"""Registered queries: one per operator of the survey inventory.

Each takes (spark, sf_dir) and returns a DataFrame over the whole driver
tables. Floating outputs are rounded (6 decimals; 4 for price x volume
levels) so the DuckDB oracle can compare values across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.functions.nulls import rnd
from panelforge.operators import benchmark as B
from panelforge.operators import windows as W
from panelforge.operators.carry import ema, forward_fill, macd
from panelforge.operators.halo import with_halo
from panelforge.operators.labels import HORIZONS, direction_col, forward_returns, panel_labels
from panelforge.operators.market import market_regime, rolling_beta, rolling_corr
from panelforge.operators.signals import momentum_signals, reversal_signal, trend_consistency
from panelforge.operators.xsection import (
    XS_FEATURES, market_breadth, market_stats, join_per_date, relative_strength, xs_rank, xs_zscore,
)
from panelforge.plans.pipeline import base_features, engineer_features
from panelforge.session import apply_conf, checkpoint_dir
from panelforge.sources import io
from panelforge.sources.bars import (
    BENCHMARKS, TICK_ORDER, benchmark_series, ohlcv_bars, stock_bars, stock_panel, trade_ticks,
)

KEYS = ["ticker", "date"]
PW = PanelWindow()
LEVELS = {c: 4 for c in ["dollar_volume", "dollar_vol_20", "volume_sma_20", "volume"]}

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def out(df: DataFrame, cols) -> DataFrame:
    return rnd(df.select(*KEYS, *cols), overrides=LEVELS)


def panel(spark, sf_dir) -> DataFrame:
    """The bar panel as a stored stage, for queries that read it in several
    branches (row positions, per-date statistics joined back): they never
    re-run the raw scan, and a lost executor recomputes from the stage.
    Queries with one branch read ``stock_panel`` itself."""
    return io.stage(stock_panel(spark, sf_dir), "bars")


def framed(spark, sf_dir, fn, back: int = 0, fwd: int = 0) -> DataFrame:
    """A rolling operator over the stored panel on halo buckets, so that no
    ticker is one task; ``back`` / ``fwd`` are the rows it reaches."""
    return with_halo(panel(spark, sf_dir), fn, PW, back, fwd)


def based(spark, sf_dir, with_macd: bool = False) -> DataFrame:
    return base_features(panel(spark, sf_dir), with_macd=with_macd)


# ---------------------------------------------------------------- sources
@query("bars_scan")
def q_bars_scan(spark, sf_dir):
    """Typed scan of the raw trades feeding the bars."""
    t = trade_ticks(spark, sf_dir)
    return t.select("ticker", F.to_date("ts").alias("date"), "px", "qty", *TICK_ORDER)


@query("load_bars")
def q_load_bars(spark, sf_dir):
    """The bars as a vendor's CSV file, read back with a typed date and
    typed fields."""
    names = {v: k for k, v in io.VENDOR_NAMES.items()}
    bars = stock_panel(spark, sf_dir).withColumns({"dividends": F.lit(None).cast("double"), "stock_splits": F.lit(0.0)})
    path = f"{checkpoint_dir(spark)}/vendor-{uuid.uuid4().hex}"
    io.write_stage(bars.select(*[F.col(c).alias(names.get(c, c)) for c in bars.columns]), path, fmt="csv")
    return io.load_bars(spark, path, "csv")


@query("ohlcv_bars")
def q_ohlcv_bars(spark, sf_dir):
    """Daily OHLCV bars per brand."""
    return stock_bars(spark, sf_dir)


@query("wide_to_long")
def q_wide_to_long(spark, sf_dir):
    """Vendor-shaped wide frame of the three benchmarks back to long."""
    tickers = list(BENCHMARKS.values())
    wide = io.to_wide(benchmark_series(spark, sf_dir), tickers, ["close"])
    return io.wide_to_long(wide, tickers, ["close"])


@query("union_panel")
def q_union_panel(spark, sf_dir):
    """Stock bars + benchmark closes; missing columns become NULL."""
    bench = benchmark_series(spark, sf_dir)
    return io.union_panel(stock_panel(spark, sf_dir), bench)


@query("sort_panel")
def q_sort_panel(spark, sf_dir):
    """S6."""
    return io.sort_panel(stock_bars(spark, sf_dir))


@query("panel_profile")
def q_panel_profile(spark, sf_dir):
    """S7."""
    return io.panel_profile(stock_bars(spark, sf_dir))


# ---------------------------------------------------------------- time windows
@query("returns_multi")
def q_returns_multi(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.returns_multi(d, w), 252), [f"return_{p}d" for p in W.RETURN_PERIODS])


@query("sma")
def q_sma(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.sma(d, w), 200), [f"sma_{n}" for n in W.SMA_PERIODS])


@query("price_to_sma")
def q_price_to_sma(spark, sf_dir):
    return out(W.price_to_sma(framed(spark, sf_dir, lambda d, w: W.sma(d, w), 200)), [f"price_to_sma{n}" for n in W.SMA_PERIODS])


@query("volume_features")
def q_volume_features(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.volume_features(d, w), 20), ["volume_sma_20", "volume_ratio"])


@query("dollar_volume")
def q_dollar_volume(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.dollar_volume(d, w), 20), ["dollar_volume", "dollar_vol_20"])


def _volatility(spark, sf_dir):
    return framed(spark, sf_dir, lambda d, w: W.volatility(W.pct_change(d, "adj_close", [1], w), w), 127)


@query("volatility")
def q_volatility(spark, sf_dir):
    return out(_volatility(spark, sf_dir), [f"volatility_{n}d" for n in W.VOL_PERIODS])


@query("vol_ratios")
def q_vol_ratios(spark, sf_dir):
    df = W.vol_ratios(_volatility(spark, sf_dir))
    return out(df, [n for n, _, _ in W.VOL_RATIOS])


@query("bar_patterns")
def q_bar_patterns(spark, sf_dir):
    return out(W.bar_patterns(stock_panel(spark, sf_dir)), ["high_low_ratio", "close_to_high"])


@query("gap")
def q_gap(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.gap(d, w), 1), ["gap"])


@query("rsi")
def q_rsi(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.rsi(d, w), 22), [f"rsi_{n}" for n in W.RSI_PERIODS])


@query("bollinger")
def q_bollinger(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.bollinger(d, w), 20), ["bb_upper", "bb_lower", "bb_position", "bb_width"])


@query("ema")
def q_ema(spark, sf_dir):
    df = ema(panel(spark, sf_dir), "adj_close", [12, 26], ["ema_12", "ema_26"])
    return out(df, ["ema_12", "ema_26"])


@query("macd")
def q_macd(spark, sf_dir):
    return out(macd(panel(spark, sf_dir)), ["macd", "macd_signal", "macd_hist"])


@query("dist_extremes")
def q_dist_extremes(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: W.dist_extremes(d, w), 252),
               ["dist_from_52w_high", "dist_from_52w_low", "dist_from_1m_high", "dist_from_1m_low"])


@query("forward_returns")
def q_forward_returns(spark, sf_dir):
    return out(framed(spark, sf_dir, lambda d, w: forward_returns(d, w), 0, 252), [f"target_return_{n}" for n, _ in HORIZONS])


@query("direction_labels")
def q_direction_labels(spark, sf_dir):
    """W22 in both modes: strict (NULL unknown) and reference (0 unknown)."""
    strict = panel_labels(panel(spark, sf_dir), mode="strict")
    cols = [f"target_direction_{n}" for n, _ in HORIZONS]
    ref = [direction_col(f"target_return_{n}", "reference").alias(f"target_direction_{n}_ref")
           for n, _ in HORIZONS]
    return strict.select(*KEYS, *cols, *ref)


# ---------------------------------------------------------------- cross-section
def _market(spark, sf_dir):
    return framed(spark, sf_dir, lambda d, w: W.pct_change(d, "adj_close", [1, 21], w), 21)


@query("market_regime")
def q_market_regime(spark, sf_dir):
    """X1-X4, J2, W15, W16 together."""
    df = market_regime(_market(spark, sf_dir))
    return out(df, ["market_return_1d", "market_volatility", "market_breadth",
                    "correlation_market", "beta", "relative_strength"])


@query("market_breadth")
def q_market_breadth(spark, sf_dir):
    return out(market_breadth(_market(spark, sf_dir)), ["market_breadth"])


@query("relative_strength")
def q_relative_strength(spark, sf_dir):
    return out(relative_strength(_market(spark, sf_dir)), ["relative_strength"])


def _with_market_return(spark, sf_dir):
    df = _market(spark, sf_dir)
    return join_per_date(df, market_stats(df).select("date", "market_return_1d"))


@query("rolling_corr")
def q_rolling_corr(spark, sf_dir):
    return out(with_halo(_with_market_return(spark, sf_dir), lambda d, w: rolling_corr(d, pw=w), PW, 64), ["correlation_market"])


@query("rolling_beta")
def q_rolling_beta(spark, sf_dir):
    return out(with_halo(_with_market_return(spark, sf_dir), lambda d, w: rolling_beta(d, pw=w), PW, 64), ["beta"])


@query("xs_rank")
def q_xs_rank(spark, sf_dir):
    df = xs_rank(based(spark, sf_dir))
    return out(df, [f"{c}_rank" for c in XS_FEATURES])


@query("xs_zscore")
def q_xs_zscore(spark, sf_dir):
    df = xs_zscore(based(spark, sf_dir))
    return out(df, [f"{c}_zscore" for c in XS_FEATURES])


@query("momentum_signals")
def q_momentum_signals(spark, sf_dir):
    return out(momentum_signals(based(spark, sf_dir)), ["momentum_1m", "momentum_3m"])


@query("reversal_signal")
def q_reversal_signal(spark, sf_dir):
    return out(reversal_signal(based(spark, sf_dir)), ["reversal_signal"])


@query("trend_consistency")
def q_trend_consistency(spark, sf_dir):
    return out(trend_consistency(based(spark, sf_dir)), ["trend_consistency"])


def top_momentum(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """Minimal slice: bars → 21-row return → dense percent rank per date; the
    top n names on the last date that has a 21-row return."""
    df = xs_rank(framed(spark, sf_dir, lambda d, w: W.pct_change(d, "adj_close", [21], w), 21), ["return_21d"])
    last = df.filter(F.col("return_21d").isNotNull()).agg(F.max("date").alias("date"))
    top = df.join(last, "date").orderBy(F.desc("return_21d_rank"), "ticker").limit(n)
    return rnd(top.select("ticker", "date", "return_21d", "return_21d_rank"))


# ---------------------------------------------------------------- full pipeline
def engineered(spark, sf_dir, label_mode: str = "strict", cols=None) -> DataFrame:
    """The engineered panel as a stage. ``cols`` (besides the keys) are selected
    before it is written, so windows that no consumer needs are pruned and the
    stage holds those columns only."""
    macd_too = cols is None or any(c.startswith("macd") for c in cols)
    df = engineer_features(panel(spark, sf_dir), label_mode=label_mode, with_macd=macd_too)
    if cols is not None:
        df = df.select(*KEYS, *[c for c in cols if c not in KEYS])
    return io.stage(df, "engineered")


@query("engineer_features")
def q_engineer_features(spark, sf_dir):
    """The whole engineered panel (74 computed columns + 12 targets)."""
    df = engineered(spark, sf_dir)
    return rnd(df, overrides=LEVELS)


# ---------------------------------------------------------------- benchmarks
def _bench_panel(spark, sf_dir):
    return (framed(spark, sf_dir, lambda d, w: W.pct_change(d, "adj_close", [21], w), 21),
            benchmark_series(spark, sf_dir))


@query("benchmark_join")
def q_benchmark_join(spark, sf_dir):
    """The three benchmark closes left-joined by date (no fill)."""
    df, bench = _bench_panel(spark, sf_dir)
    table = B.series_table(bench)
    return out(B.benchmark_join(df, table, ["nasdaq_close", "spy_close", "vix_level"]),
               ["nasdaq_close", "spy_close", "vix_level"])


@query("benchmark_asof")
def q_benchmark_asof(spark, sf_dir):
    """Backward as-of join of the three closes on date."""
    df, bench = _bench_panel(spark, sf_dir)
    cols = ["nasdaq_close", "spy_close", "vix_level"]
    return out(B.asof_join(df, B.series_table(bench), cols), cols)


def _bench_features(spark, sf_dir):
    df, bench = _bench_panel(spark, sf_dir)
    return B.benchmark_features(df, bench)


@query("benchmark_returns")
def q_benchmark_returns(spark, sf_dir):
    """21-row benchmark returns and the VIX level, filled per ticker."""
    return out(_bench_features(spark, sf_dir),
               ["nasdaq_return_1m", "spy_return_1m", "vix_level", "vix_change_1m"])


@query("benchmark_regime")
def q_benchmark_regime(spark, sf_dir):
    """ETF close / 200-row SMA - 1."""
    return out(_bench_features(spark, sf_dir), ["spy_sma200_ratio"])


@query("rel_strength_benchmark")
def q_rel_strength_benchmark(spark, sf_dir):
    """W20."""
    return out(_bench_features(spark, sf_dir), ["relative_strength_nasdaq", "relative_strength_spy"])


@query("benchmark_beta")
def q_benchmark_beta(spark, sf_dir):
    """63-row beta against the broad index, per ticker."""
    return out(_bench_features(spark, sf_dir), ["beta_nasdaq"])


@query("forward_fill")
def q_forward_fill(spark, sf_dir):
    """Benchmark closes joined by date, then carried forward per ticker."""
    df, bench = _bench_panel(spark, sf_dir)
    cols = ["nasdaq_close", "spy_close", "vix_level"]
    joined = B.benchmark_join(df.select(*KEYS), B.series_table(bench), cols)
    return out(forward_fill(joined, cols), cols)
