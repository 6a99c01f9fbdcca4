"""Scaling (Z1-Z5, J4, S10 for scaler parameters).

Robust scaling per ticker produces a long parameter table (ticker, feature,
center, scale, n_train) from training rows; applying it is a join on ticker.
No broadcast hint: the table grows with the number of tickers, so Spark's
size-checked planner (and AQE at runtime, which also splits a hot ticker)
choose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.nulls import div
from panelforge.functions.quantiles import exact_quantiles

QUANTILES = [0.25, 0.5, 0.75]


def fit_scaler(df: DataFrame, cols: Sequence[str], cut: str, key: str = "ticker",
               time: str = "date", min_rows: int = 10, method: str = "exact",
               accuracy: int = 10000) -> DataFrame:
    """Median and IQR of each column per ticker on rows before ``cut``.

    NULL counts as 0 (the reference fills before fitting); an IQR of 0 gives
    scale 1; tickers with fewer than ``min_rows`` training rows get no
    parameters. Quantiles follow numpy's linear rule.

    ``method="exact"`` (default) ranks distinct values in bounded ranges
    (``functions.quantiles``), so no ticker's series is held in one task;
    ``"approx"`` is the ``percentile_approx`` sketch.
    """
    train = df.filter(F.col(time) < F.lit(cut).cast("date"))
    if method == "exact":
        long = train.select(key, F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"),
                     F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")) for c in cols])))
        q = exact_quantiles(long, [key, "feature"], "x", QUANTILES)
        iqr = F.col("q2") - F.col("q0")
        return (q.filter(F.col("n") >= min_rows)
                .select(key, "feature", F.col("q1").alias("center"),
                        F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"),
                        F.col("n").alias("n_train")))
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    aggs = [F.count(F.lit(1)).alias("n_train")]
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs.append(F.percentile_approx(x, qs, accuracy).alias(f"__q_{c}"))
    wide = train.groupBy(key).agg(*aggs).filter(F.col("n_train") >= min_rows)
    rows = []
    for c in cols:
        q = F.col(f"__q_{c}")
        iqr = q[2] - q[0]
        rows.append(F.struct(F.lit(c).alias("feature"), q[1].alias("center"),
                             F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale")))
    return wide.select(key, F.inline(F.array(*rows)), "n_train")


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str],
                 key: str = "ticker") -> DataFrame:
    """(coalesce(x, 0) - center) / scale for tickers with
    parameters; tickers without them pass through unchanged."""
    per_ticker = params.groupBy(key).agg(*[
        agg for c in cols for agg in (
            F.max(F.when(F.col("feature") == c, F.col("center"))).alias(f"__c_{c}"),
            F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"__s_{c}"))
    ]).withColumn("__fitted", F.lit(True))
    j = df.join(per_ticker, key, "left")
    fitted = F.col("__fitted").isNotNull()
    out = []
    for c in df.columns:
        if c in cols:
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            out.append(F.when(fitted, (x - F.col(f"__c_{c}")) / F.col(f"__s_{c}"))
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)


def robust_scale(df: DataFrame, cols: Sequence[str], cut: str, key: str = "ticker",
                 time: str = "date", min_rows: int = 10,
                 method: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Fit on the training period and transform every row."""
    params = fit_scaler(df, cols, cut, key, time, min_rows, method)
    return apply_scaler(df, params, cols, key), params


def save_params(params: DataFrame, path: str) -> None:
    """Store fitted parameters (Parquet)."""
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) over the whole table; a constant column
    gives 0 (the reference's scaler), NULL stays NULL.

    The statistics are one global row, so joining them is a one-row broadcast.
    """
    stats = df.agg(*[a for c in cols for a in (F.min(c).alias(f"__mn_{c}"), F.max(c).alias(f"__mx_{c}"))])
    j = df.crossJoin(F.broadcast(stats))
    out = []
    for c in df.columns:
        if c in cols:
            mn, mx = F.col(f"__mn_{c}"), F.col(f"__mx_{c}")
            rng = mx - mn
            out.append(F.when(rng == 0, F.col(c) - mn).otherwise(div(F.col(c) - mn, rng))
                       .cast("double").alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)


def binary_remap(df: DataFrame, col: str) -> DataFrame:
    """A target with at most two values maps smaller → 0, larger → 1;
    any other target is min-max scaled."""
    stats = df.agg(F.countDistinct(col).alias("__nd"), F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    j = df.crossJoin(F.broadcast(stats))
    x, mn, mx = F.col(col), F.col("__mn"), F.col("__mx")
    binary = F.when(x.isNotNull(), F.when(x == mn, F.lit(0.0)).otherwise(F.lit(1.0)))
    rng = mx - mn
    scaled = F.when(rng == 0, x - mn).otherwise(div(x - mn, rng)).cast("double")
    val = F.when(F.col("__nd") <= 2, binary).otherwise(scaled)
    return j.select(*[val.alias(c) if c == col else F.col(c) for c in df.columns])
