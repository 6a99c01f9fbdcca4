"""Market-regime features.

Rolling co-moments need n complete pairs. Spark's ``corr`` raises under ANSI
on a constant column, so correlation is composed from population moments
over pair-complete rows with ``try_divide`` (constant → NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.functions.nulls import div
from panelforge.operators.halo import with_halo
from panelforge.operators.xsection import join_per_date, market_stats

PW = PanelWindow()


def _pairs(a: str, b: str) -> tuple[Column, Column]:
    ca, cb = F.col(a), F.col(b)
    return F.when(cb.isNotNull(), ca), F.when(ca.isNotNull(), cb)


def rolling_corr_col(a: str, b: str, n: int, pw: PanelWindow = PW) -> Column:
    pa, pb = _pairs(a, b)
    w = pw.rows(n)
    corr = div(F.covar_pop(pa, pb).over(w),
               F.stddev_pop(pa).over(w) * F.stddev_pop(pb).over(w))
    return F.when(F.count(pa).over(w) == n, corr)


def rolling_beta_col(y: str, x: str, n: int, pw: PanelWindow = PW) -> Column:
    """cov(y, x) over n complete pairs / var(x) over n rows of x alone."""
    py, px = _pairs(y, x)
    w = pw.rows(n)
    cov = F.when(F.count(py).over(w) == n, F.covar_samp(py, px).over(w))
    var = F.when(F.count(x).over(w) == n, F.var_samp(x).over(w))
    return div(cov, var)


def rolling_corr(df: DataFrame, a: str = "return_1d", b: str = "market_return_1d", n: int = 63,
                 pw: PanelWindow = PW, out: str = "correlation_market") -> DataFrame:
    """W15."""
    return df.withColumn(out, rolling_corr_col(a, b, n, pw))


def rolling_beta(df: DataFrame, y: str = "return_1d", x: str = "market_return_1d", n: int = 63,
                 pw: PanelWindow = PW, out: str = "beta") -> DataFrame:
    """W16."""
    return df.withColumn(out, rolling_beta_col(y, x, n, pw))


# Columns of the market regime (W15, W16, X1-X4) in the reference's order.
REGIME = ["market_return_1d", "market_volatility", "market_breadth", "correlation_market", "beta", "relative_strength"]


def market_regime(df: DataFrame, pw: PanelWindow = PW, n: int = 63) -> DataFrame:
    """X1-X4 + W15 + W16 in the reference's column order.

    One per-date aggregate (mean, std, breadth, median of the 21-row return)
    is broadcast back; the rolling co-moments then run on halo buckets.
    """
    base = list(df.columns)
    out = with_halo(market_join(df, pw), lambda d, w: market_comoments(d, w, n), pw, n + 1)
    return out.select(base + [c for c in REGIME if c in out.columns])


def market_join(df: DataFrame, pw: PanelWindow = PW) -> DataFrame:
    """The per-date aggregate joined back, relative strength."""
    median = "return_21d" if "return_21d" in df.columns else None
    return join_statistics(df, market_stats(df, time=pw.time, median_of=median), pw.time)


def join_statistics(df: DataFrame, stats: DataFrame, time: str = "date") -> DataFrame:
    """Per-date statistics onto the panel; relative strength where there is
    a median."""
    out = join_per_date(df, stats, time)
    if "__median" in stats.columns:
        out = out.withColumn("relative_strength", F.col("return_21d") - F.col("__median")).drop("__median")
    return out


def market_comoments(df: DataFrame, pw: PanelWindow = PW, n: int = 63) -> DataFrame:
    """W15 / W16 against the joined market return, sharing one set of frame
    moments: when all n pairs are complete the market column equals its
    pair-masked copy on the frame, so beta = cov / var(market) needs no
    separate frame (the n / (n - 1) factors of the sample forms cancel)."""
    pa = "CASE WHEN market_return_1d IS NOT NULL THEN return_1d END"
    pb = "CASE WHEN return_1d IS NOT NULL THEN market_return_1d END"
    w = pw.over(n)
    df = df.selectExpr("*", f"count({pa}) {w} AS __n", f"covar_pop({pa}, {pb}) {w} AS __cov",
                       f"stddev_pop({pa}) {w} AS __sa", f"stddev_pop({pb}) {w} AS __sb")
    return df.selectExpr("*", f"CASE WHEN __n = {n} THEN try_divide(__cov, __sa * __sb) END AS correlation_market",
                         f"CASE WHEN __n = {n} THEN try_divide(__cov, __sb * __sb) END AS beta").drop(
                             "__n", "__cov", "__sa", "__sb")
