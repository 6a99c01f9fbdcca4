"""Feature quality and selection statistics.

Every statistic over all rows is a single aggregation pass, combined
map-side; the per-feature results are stacked into long tables with
``inline`` (no shuffle). Correlations are composed from population moments
with ``try_divide`` (Spark's ``corr`` raises on a constant column under ANSI).
Correlation matrices are one pass: Spark ML's centred Gramian for complete
columns, masked Gramians summed in blocks where values are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import div



def _corr_pair(a: str, b: str) -> Column:
    """Pearson correlation over rows where both sides are non-null."""
    ca, cb = F.col(a), F.col(b)
    pa = F.when(cb.isNotNull(), ca)
    pb = F.when(ca.isNotNull(), cb)
    return div(F.covar_pop(pa, pb), F.stddev_pop(pa) * F.stddev_pop(pb))


def _stack(row_df: DataFrame, structs: list[Column]) -> DataFrame:
    return row_df.select(F.inline(F.array(*structs)))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str,
                     top: int | None = 15) -> DataFrame:
    """|corr(feature, target)| per feature, strongest first (top-k report)."""
    aggs = [_corr_pair(f, target).alias(f"__c{i}") for i, f in enumerate(features)]
    one = df.agg(*aggs)
    res = _stack(one, [F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"__c{i}")).alias("abs_corr"))
                       for i, f in enumerate(features)])
    res = res.orderBy(F.desc_nulls_last("abs_corr"), "feature")
    return res.limit(top) if top else res


GRAM_ROWS = 8192    # rows of a block that is multiplied at once


def masked_moments(df: DataFrame, cols: Sequence[str], pivots: Sequence[float]) -> DataFrame:
    """One row per pair (i <= j) of columns: over the rows that have both, n,
    the sums si, sj, the squares qi, qj and the product p of the columns less
    their pivots.

    One pass: with X the values (0 where missing) and M the mask, a block adds
    X'X, X'M, (X*X)'M and M'M. A task sends on one row a pair, summed map-side
    again before the shuffle, so the work does not grow with an expression per
    pair."""
    k = len(cols)
    shift = np.array(pivots, dtype=float)
    upper = np.triu_indices(k)

    def run(frames):
        total = np.zeros((4, k, k))
        for f in frames:
            v = f.to_numpy(dtype=float, na_value=np.nan)
            for at in range(0, len(v), GRAM_ROWS):
                x = v[at:at + GRAM_ROWS] - shift
                m = ~np.isnan(x)
                x[~m] = 0.0
                m = m.astype(float)
                total += np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
        g, s, q, n = total
        i, j = upper
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": n[i, j], "si": s[i, j], "sj": s[j, i],
                            "qi": q[i, j], "qj": q[j, i], "p": g[i, j]})

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(
        run, "i int, j int, n double, si double, sj double, qi double, qj double, p double")
    return rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])


# A variance below this share of the mean square is rounding: the column is
# constant on the pair's rows.
FLAT = 1e-13


def corr_matrix(df: DataFrame, cols: Sequence[str], lower: bool = True) -> DataFrame:
    """pairwise-complete correlation as a long table (feature_a, feature_b,
    corr); ``lower`` keeps the strict lower triangle (a after b in ``cols``).
    NULL where a column is constant on the rows that have both. Columns are
    taken less their mean first (one number a column reaches the driver)."""
    if not cols:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    one = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"))]).first()
    pivots = [0.0 if one[f"m{i}"] is None else float(one[f"l{i}"] if one[f"l{i}"] == one[f"h{i}"] else one[f"m{i}"])
              for i in range(len(cols))]
    t = masked_moments(df, cols, pivots).where("i < j and n > 0")
    names = F.array(*[F.lit(c) for c in cols])

    def spread(q, s):
        v = F.col(q) - F.col(s) * F.col(s) / F.col("n")
        return F.when(v > FLAT * F.col(q), v)

    corr = (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(spread("qi", "si") * spread("qj", "sj"))
    a, b = F.element_at(names, F.col("j") + 1), F.element_at(names, F.col("i") + 1)
    t = t.select(a.alias("feature_a"), b.alias("feature_b"), corr.alias("corr"))
    # pairs without a common row still have a row each
    pairs = df.sparkSession.createDataFrame([(cols[j], cols[i]) for i in range(len(cols)) for j in range(i + 1, len(cols))],
                                            "feature_a string, feature_b string")
    t = pairs.join(t, ["feature_a", "feature_b"], "left")
    if lower:
        return t
    return t.unionByName(t.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "corr"))


def dense_corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper-triangle Pearson correlations (pos_a < pos_b) of columns without
    NULLs, as a long table.

    One distributed pass of Spark ML's ``Correlation`` (column means, then
    the Gramian of mean-centred rows, combined by tree aggregation). Only the
    k x k matrix returns to the driver: its size is bounded by the number of
    features, not by the data. A constant column gives NULL.
    """
    from pyspark.ml.stat import Correlation
    vec = VectorAssembler(inputCols=list(cols), outputCol="__v").transform(df.select(*cols))
    m = Correlation.corr(vec, "__v", "pearson").first()[0].toArray()
    rows = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            v = float(m[i, j])
            rows.append((i, j, cols[i], cols[j], None if math.isnan(v) else v))
    return df.sparkSession.createDataFrame(
        rows, "pos_a int, pos_b int, feature_a string, feature_b string, corr double")


def variance_filter(df: DataFrame, cols: Sequence[str], t: float = 0.01) -> DataFrame:
    """columns whose population variance is strictly above ``t``."""
    one = df.agg(*[F.var_pop(c).alias(f"__v{i}") for i, c in enumerate(cols)])
    res = _stack(one, [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                                F.col(f"__v{i}").alias("variance")) for i, c in enumerate(cols)])
    return res.filter(F.col("variance") > t)


def correlation_filter(df: DataFrame, cols: Sequence[str], t: float = 0.95) -> DataFrame:
    """drop a column when any earlier column correlates above ``t`` in
    absolute value (even an earlier column that is itself dropped)."""
    pairs = dense_corr_pairs(df, cols)
    dropped = pairs.filter(F.abs(F.col("corr")) > t).select(F.col("pos_b").alias("position")).distinct()
    names = _stack(df.sparkSession.range(1), [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"))
                                              for i, c in enumerate(cols)])
    return names.join(dropped, "position", "left_anti")


def mutual_info(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """F6 (re-aimed): mutual information between each feature, cut into
    ``bins`` equal-width bins over its range, and the class label.

    Min / max are one global row; bin counts are one aggregate over the
    features stacked to (feature, bin, label), combined map-side.
    """
    rng = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(c).alias(f"__mn{i}"), F.max(c).alias(f"__mx{i}"))])
    j = df.crossJoin(F.broadcast(rng))
    structs = []
    for i, c in enumerate(cols):
        mn, mx = F.col(f"__mn{i}"), F.col(f"__mx{i}")
        b = F.when(mx == mn, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - mn) / (mx - mn) * bins), F.lit(bins - 1))).cast("int")
        structs.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    long = j.select(F.col(label).alias("y"), F.inline(F.array(*structs)))
    cnt = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    wf = Window.partitionBy("feature")
    wb = Window.partitionBy("feature", "bin")
    wy = Window.partitionBy("feature", "y")
    p = cnt.select("feature", (F.col("n") / F.sum("n").over(wf)).alias("pxy"),
                   (F.sum("n").over(wb) / F.sum("n").over(wf)).alias("px"),
                   (F.sum("n").over(wy) / F.sum("n").over(wf)).alias("py"))
    return p.groupBy("feature").agg(
        F.sum(F.col("pxy") * F.log(F.col("pxy") / (F.col("px") * F.col("py")))).alias("mi"))


def top_by(scores: DataFrame, score: str, n: int, feature: str = "feature") -> DataFrame:
    """Top n features by score, ties by name; rank 1 is the best."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc(score), F.col(feature))
    return scores.orderBy(F.desc(score), F.col(feature)).limit(n).withColumn("rank", F.row_number().over(w))


def intersect_selections(a: DataFrame, b: DataFrame, feature: str = "feature") -> DataFrame:
    """Features present in both selections (left-semi join)."""
    return a.select(feature).distinct().join(b.select(feature), feature, "left_semi")


def feature_report(corrs: DataFrame, importances: DataFrame) -> DataFrame:
    """Abs correlation with the importance mapped by feature name,
    missing importance → 0."""
    return (corrs.join(importances, "feature", "left")
            .select("feature", "abs_corr", F.coalesce("importance", F.lit(0.0)).alias("importance")))


def feature_duel(report: DataFrame, raw: str = "sma_20", ratio: str = "price_to_sma20") -> DataFrame:
    """the raw level against its ratio form, side by side in the report."""
    return report.filter(F.col("feature").isin(raw, ratio)).withColumn(
        "form", F.when(F.col("feature") == raw, "raw").otherwise("ratio"))
