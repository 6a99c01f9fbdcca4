"""Composite plans: the full feature pipeline (X10) and its stages.

Shuffle budget of ``engineer_features`` on the wide panel:

1. the period table (rows and MACD summaries per ticker and year, stored);
2. per-date market statistics from a frame of three columns: one exchange of
   narrow rows on (ticker, bucket), one map-side-combined aggregate per date;
3. one exchange of the panel on (ticker, bucket): features, labels, MACD, and,
   with the statistics broadcast (one row a date), the rolling co-moments
   against the market, whose halo rows are still there;
4. one exchange on date for the cross-sectional ranks and z-scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.operators import windows as W
from panelforge.operators.carry import Macd, macd
from panelforge.operators.features import feature_names, frame_features, panel_features
from panelforge.operators.halo import BACK, BUCKET, FWD, periods_of, with_halo
from panelforge.operators.market import REGIME, join_statistics, market_comoments

SIGNAL_COLUMNS = ["momentum_1m", "momentum_3m", "reversal_signal", "trend_consistency"]
from panelforge.operators.signals import signals
from panelforge.operators.xsection import cross_sectional, market_stats

PW = PanelWindow()

# Columns that are inputs, not features, and raw levels kept out of the model
# (fixed values, the reference's exclusion list).
RAW_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "adj_close",
               "volume", "dividends", "stock_splits"]
RAW_LEVELS = ["bb_upper", "bb_lower", "macd", "macd_signal", "volume_sma_20", "dollar_volume",
              "dollar_vol_20", "sma_5", "sma_10", "sma_20", "sma_50", "sma_100", "sma_200"]

# Features rescaled per ticker on the training period (fixed values).
SCALABLE = ["dollar_volume_rank", "dollar_volume_zscore", "market_volatility", "beta",
            "correlation_market", "return_1d", "return_5d", "return_21d", "return_63d",
            "rsi_14", "bb_position", "macd_hist", "dist_from_52w_high"]


def base_features_chained(df: DataFrame, pw: PanelWindow = PW) -> DataFrame:
    """W1-W14 composed from the standalone operators (one window level each);
    kept as the reference implementation the fused plan is tested against."""
    df = W.returns_multi(df, pw)
    df = W.sma(df, pw)
    df = W.price_to_sma(df)
    base = [c for c in df.columns if not c.startswith(("sma_", "price_to_sma"))]
    df = df.select(base + [x for n in W.SMA_PERIODS for x in (f"sma_{n}", f"price_to_sma{n}")])
    df = W.volume_features(df, pw)
    df = W.dollar_volume(df, pw)
    df = W.volatility(df, pw)
    df = W.vol_ratios(df)
    df = W.bar_patterns(df)
    df = W.gap(df, pw)
    df = W.rsi(df, pw)
    df = W.bollinger(df, pw)
    df = macd(df, pw)
    df = W.dist_extremes(df, pw)
    return df


def base_features(df: DataFrame, pw: PanelWindow = PW, with_macd: bool = True) -> DataFrame:
    """W1-W14 in the reference's column order, in the fewest window passes."""
    return panel_features(df, pw, with_macd=with_macd)


def engineer_features(df: DataFrame, pw: PanelWindow = PW, label_mode: str = "strict",
                      universe: DataFrame | None = None, bucket: int = BUCKET,
                      with_macd: bool = True) -> DataFrame:
    """Base -> market regime -> cross-section -> signals -> targets.

    Labels only need the ticker order, so they are computed with the base
    features (same pass) and moved to the end of the column list. ``universe``
    (ticker column) keeps only the listed tickers first (index rows out).
    ``with_macd`` = False leaves out the MACD columns and their stage.
    """
    if universe is not None:
        df = df.join(universe.select(pw.key).distinct(), pw.key, "left_semi")
    return engineer_rows(df, periods_of(df, pw, carried(with_macd)), pw, label_mode, bucket, with_macd)


def carried(with_macd: bool = True) -> list:
    """States of the engineered panel that reach back without bound."""
    return [Macd()] if with_macd else []


def market_table(df: DataFrame, table: DataFrame, pw: PanelWindow = PW, bucket: int = BUCKET) -> DataFrame:
    """One row a date of market statistics, from a frame of three columns."""
    narrow = with_halo(df.select(pw.key, pw.time, "adj_close"), lambda d, w: W.pct_change(d, "adj_close", [1, 21], w),
                       pw, 21, 0, bucket, periods=table)
    return market_stats(narrow, time=pw.time, median_of="return_21d")


def engineer_rows(df: DataFrame, table: DataFrame, pw: PanelWindow = PW, label_mode: str = "strict",
                  bucket: int = BUCKET, with_macd: bool = True, stats: DataFrame | None = None,
                  since: int | None = None) -> DataFrame:
    """``engineer_features`` with the period table of the whole panel (and the
    market statistics of all dates) at hand. With ``since`` only the rows of
    the years from it on are returned; ``df`` then needs no more than these and
    the rows that they reach back to."""
    if stats is None:
        stats = market_table(df, table, pw, bucket)

    def frame(d: DataFrame, w: PanelWindow) -> DataFrame:
        d = frame_features(d, w, "adj_close", label_mode)
        return market_comoments(join_statistics(d, stats, pw.time), w)

    names = feature_names(label_mode, with_macd)
    targets = [c for c in names if c.startswith("target_")]
    out = with_halo(df, frame, pw, BACK, FWD, bucket, carried(with_macd), table)
    if since is not None:
        out = out.where(F.year(pw.time) >= since)
    out = out.select(*df.columns, *[c for c in names if c not in targets], *REGIME, *targets)
    out = signals(cross_sectional(out, time=pw.time))
    return out.select([c for c in out.columns if c not in targets] + targets)


def feature_columns(df: DataFrame) -> list[str]:
    """Every column that is not raw input, a target or a raw level."""
    drop = set(RAW_COLUMNS) | set(RAW_LEVELS)
    return [c for c in df.columns if c not in drop and not c.startswith("target_")]
