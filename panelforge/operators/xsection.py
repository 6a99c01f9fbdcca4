"""Cross-sectional operators: statistics of one date across tickers.

Per-date means, deviations, breadth and medians are aggregates: Spark
combines them map-side, and their result has one row per date, so it is
joined back by broadcast when the time column is a DATE (a daily calendar is
bounded: a century is 36,525 rows). Ranks need the ordered cross-section and
run as a window partitioned by date; a date holds at most one row per ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

# Features ranked and z-scored within each date (fixed values).
XS_FEATURES = ["return_1d", "return_5d", "return_21d", "return_63d",
               "volume_ratio", "volatility_21d", "rsi_14", "dollar_volume"]


def join_per_date(df: DataFrame, stats: DataFrame, time: str = "date") -> DataFrame:
    """Left-join a one-row-per-date table back onto the panel.

    Broadcast only when the key is a DATE, whose distinct count is bounded by
    the calendar; otherwise Spark's size-checked planner decides.
    """
    if isinstance(df.schema[time].dataType, DateType):
        stats = F.broadcast(stats)
    return df.join(stats, on=time, how="left")


def market_stats(df: DataFrame, ret: str = "return_1d", time: str = "date",
                 median_of: str | None = None) -> DataFrame:
    """X1-X3 as one aggregate: equal-weight mean, sample std, share of risers.

    Breadth divides by every row of the date, NULL returns and index rows
    included (pandas ``(r > 0).mean()``).
    """
    r = F.col(ret)
    aggs = [
        F.avg(r).alias("market_return_1d"),
        F.stddev_samp(r).alias("market_volatility"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("market_breadth"),
    ]
    if median_of:
        aggs.append(F.median(median_of).alias("__median"))
    return df.groupBy(time).agg(*aggs)


def market_breadth(df: DataFrame, ret: str = "return_1d", time: str = "date") -> DataFrame:
    stats = df.groupBy(time).agg(
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("market_breadth"))
    return join_per_date(df, stats, time)


def relative_strength(df: DataFrame, col: str = "return_21d", time: str = "date",
                      approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Value minus the date's median (exact, interpolated like pandas).

    ``approx=True`` swaps in ``percentile_approx`` for very wide dates.
    """
    med = (F.percentile_approx(col, 0.5, accuracy) if approx
           else F.median(col))
    stats = df.groupBy(time).agg(med.alias("__median"))
    out = join_per_date(df, stats, time)
    return out.withColumn("relative_strength", F.col(col) - F.col("__median")).drop("__median")


def xs_rank(df: DataFrame, cols: Sequence[str] = XS_FEATURES, time: str = "date") -> DataFrame:
    """Dense percent rank within the date: dense_rank / distinct non-null
    values; NULL stays NULL (pandas ``rank(pct=True, method='dense')``)."""
    cols = [c for c in cols if c in df.columns]
    base = [f"`{c}`" for c in df.columns]
    df = df.selectExpr("*", *[
        f"CASE WHEN `{c}` IS NOT NULL THEN dense_rank() OVER (PARTITION BY `{time}` ORDER BY `{c}` ASC NULLS LAST) END AS `__dr_{c}`"
        for c in cols])
    return df.selectExpr(*base, *[
        f"try_divide(CAST(`__dr_{c}` AS DOUBLE), max(`__dr_{c}`) OVER (PARTITION BY `{time}`)) AS `{c}_rank`" for c in cols])


def xs_zscore(df: DataFrame, cols: Sequence[str] = XS_FEATURES, time: str = "date") -> DataFrame:
    """(x - mean) / sample std within the date."""
    cols = [c for c in cols if c in df.columns]
    w = f"OVER (PARTITION BY `{time}`)"
    return df.selectExpr("*", *[
        f"try_divide(`{c}` - avg(`{c}`) {w}, stddev_samp(`{c}`) {w}) AS `{c}_zscore`" for c in cols])


def cross_sectional(df: DataFrame, cols: Sequence[str] = XS_FEATURES,
                    time: str = "date") -> DataFrame:
    """Ranks and z-scores interleaved per feature, as the reference lays them out."""
    cols = [c for c in cols if c in df.columns]
    base = list(df.columns)
    out = xs_zscore(xs_rank(df, cols, time), cols, time)
    order = base + [n for c in cols for n in (f"{c}_rank", f"{c}_zscore")]
    return out.select(order)
