"""Benchmark enrichment.

The three benchmark series (broad index, ETF, volatility index) are reshaped
into one row per date before anything touches the panel, so the panel meets
them in a single join instead of three. That table has one row per calendar
date (bounded), so it is broadcast and the panel is never shuffled for it.

Corrections to the reference, stated: forward fill and the benchmark beta run
per ticker (the reference fills across ticker boundaries), and relative
strength reads ``return_21d`` (the reference names a column nothing makes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from panelforge.functions.frames import PanelWindow
from panelforge.functions.nulls import div
from panelforge.operators.carry import Fill
from panelforge.operators.halo import with_halo
from panelforge.operators.market import rolling_beta_col
from panelforge.sources.bars import BENCHMARKS
from panelforge.sources.io import stage

PW = PanelWindow()

# Output names of the enrichment (fixed values).
FILLED = ["nasdaq_return_1m", "spy_return_1m", "vix_level", "vix_change_1m", "spy_sma200_ratio"]


def _bcast(df: DataFrame, time: str) -> DataFrame:
    return F.broadcast(df) if isinstance(df.schema[time].dataType, DateType) else df


def series_table(bench: DataFrame, broad: str = BENCHMARKS["broad"], etf: str = BENCHMARKS["etf"],
                 vol: str = BENCHMARKS["vol"], time: str = "date", n_ret: int = 21,
                 n_sma: int = 200) -> DataFrame:
    """One row per date: closes and features of each series on its own rows.

    Returns use the filled ``pct_change`` (pandas default fill) over the
    series' own trading rows; the ETF regime is close / 200-row SMA - 1.
    """
    sw = PanelWindow(key="ticker", time=time)
    s = bench.filter(F.col("ticker").isin(broad, etf, vol)).select("ticker", time, "close")
    filled = F.last("close", ignorenulls=True).over(sw.running)
    s = s.withColumn("__f", filled)
    s = s.withColumn("__ret", div(F.col("__f"), F.lag("__f", n_ret).over(sw.ordered)) - 1)
    s = s.withColumn("__regime", div(F.col("close"), sw.roll("close", n_sma, "avg")) - 1)

    def pick(t, c):
        return F.max(F.when(F.col("ticker") == t, F.col(c)))

    return s.groupBy(time).agg(
        pick(broad, "close").alias("nasdaq_close"),
        pick(broad, "__ret").alias("nasdaq_return_1m"),
        pick(etf, "close").alias("spy_close"),
        pick(etf, "__ret").alias("spy_return_1m"),
        pick(etf, "__regime").alias("spy_sma200_ratio"),
        pick(vol, "close").alias("vix_level"),
        pick(vol, "__ret").alias("vix_change_1m"),
    )


def benchmark_join(df: DataFrame, table: DataFrame, cols, time: str = "date") -> DataFrame:
    """Left equi-join of the per-date benchmark table (broadcast)."""
    return df.join(_bcast(table.select(time, *cols), time), time, "left")


def asof_join(df: DataFrame, series: DataFrame, cols, time: str = "date") -> DataFrame:
    """Backward as-of join on time: each panel row gets the latest series
    row at or before its date, even if that date is not in the panel.

    The fill runs on the calendar (distinct dates of panel and series, one
    row per date), not on the panel, and in two levels so no window spans
    the whole calendar: a running fill inside each year, then each year's
    gaps at the start take the last value of the years before it (a table
    of one row per year). The filled calendar is broadcast to the panel.
    """
    year = F.year(time).alias("__y")
    cal = stage(df.select(time).distinct()
                .join(series.select(time, *cols), time, "full_outer")
                .select("*", year), "calendar")   # small, read by two branches
    inside = Window.partitionBy("__y").orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cal.select(time, "__y", *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in cols])
    # last non-null value of each year, carried over the years that follow
    ends = cal.groupBy("__y").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c)
                                    for c in cols])
    before = Window.orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__y", *[F.last(c, ignorenulls=True).over(before).alias(f"__carry_{c}") for c in cols])
    cal = filled.join(F.broadcast(carry), "__y", "left").select(
        time, *[F.coalesce(F.col(c), F.col(f"__carry_{c}")).alias(c) for c in cols])
    return df.join(_bcast(cal, time), time, "left")


def benchmark_features(df: DataFrame, bench: DataFrame, pw: PanelWindow = PW,
                       n_beta: int = 63) -> DataFrame:
    """Benchmark returns, regime, VIX, relative strength, beta.

    ``df`` needs close and return_21d. Left join by date, then per-ticker
    forward fill of the five series features (reference holiday handling).
    """
    table = stage(series_table(bench, time=pw.time), "series")   # one row a date, read by two branches
    out = benchmark_join(df, table, ["nasdaq_close", *FILLED], pw.time)
    fill = Fill({**{c: c for c in FILLED}, "close": "__fs", "nasdaq_close": "__fb"})

    def frames(d: DataFrame, w: PanelWindow) -> DataFrame:
        # beta vs the broad index: filled daily changes of both closes, per ticker
        d = d.withColumn("__sret", div(F.col("__fs"), w.lag("__fs", 1)) - 1)
        d = d.withColumn("__bret", div(F.col("__fb"), w.lag("__fb", 1)) - 1)
        return d.withColumn("beta_nasdaq", rolling_beta_col("__sret", "__bret", n_beta, w))

    out = with_halo(out, frames, pw, n_beta + 1, states=[fill])
    out = out.withColumn("relative_strength_nasdaq", F.col("return_21d") - F.col("nasdaq_return_1m"))
    out = out.withColumn("relative_strength_spy", F.col("return_21d") - F.col("spy_return_1m"))
    return out.drop("__sret", "__bret", "__fs", "__fb", "nasdaq_close")
