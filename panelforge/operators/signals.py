"""Interaction and trend signals (X7-X9): row expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import flag

# SMA pairs whose ordering defines trend consistency (fixed values).
TREND_PAIRS = [(5, 10), (10, 20), (20, 50), (50, 200)]


def momentum_signals(df: DataFrame) -> DataFrame:
    """Returns weighted by relative volume."""
    return df.select("*",
                     (F.col("return_21d") * F.col("volume_ratio")).alias("momentum_1m"),
                     (F.col("return_63d") * F.col("volume_ratio")).alias("momentum_3m"))


def reversal_signal(df: DataFrame) -> DataFrame:
    """-dist_from_1m_high where RSI(14) > 70, else 0 (NULL dist stays NULL).
    ``+ 0.0`` folds -0.0 into 0.0."""
    return df.withColumn(
        "reversal_signal",
        -F.col("dist_from_1m_high") * flag(F.col("rsi_14") > 70) + F.lit(0.0))


def trend_consistency(df: DataFrame) -> DataFrame:
    """Share of the four SMA pairs in rising order; a missing SMA counts as no."""
    s = sum((flag(F.col(f"sma_{a}") > F.col(f"sma_{b}")) for a, b in TREND_PAIRS), F.lit(0))
    return df.withColumn("trend_consistency", s / 4.0)


def signals(df: DataFrame) -> DataFrame:
    return trend_consistency(reversal_signal(momentum_signals(df)))
