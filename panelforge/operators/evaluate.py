"""Out-of-time evaluation.

Scores live in one long table (target, model, key, time, y, p): all metrics
of all (target, model) pairs come from one grouped aggregate instead of one
evaluation loop per model.

ROC AUC is exact (ties count one half): scores are first collapsed to
distinct values with positive / negative counts (map-side combined), then
each group's score axis is cut into parts of bounded size, so the
running count of negatives below a score is a window inside one
(group, range) plus a small per-range offset. No group's scores ever sit in
a single task, however large the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.nulls import div
from panelforge.functions.quantiles import below, ranged

# float64 machine epsilon: probabilities are clipped to [eps, 1 - eps].
EPS = 2.220446049250313e-16
METRICS = ["accuracy", "auc", "f1"]


def predictions(scores: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Class decision from a probability: 1 when p > threshold."""
    return scores.withColumn("pred", (F.col(p) > threshold).cast("int"))


def confusion(y: Column, pred: Column) -> list[Column]:
    return [
        F.count_if((y == 0) & (pred == 0)).alias("true_neg"),
        F.count_if((y == 0) & (pred == 1)).alias("false_pos"),
        F.count_if((y == 1) & (pred == 0)).alias("false_neg"),
        F.count_if((y == 1) & (pred == 1)).alias("true_pos"),
    ]


def confusion_matrix(scores: DataFrame, by: Sequence[str] = ("target", "model"),
                     y: str = "y", p: str = "p") -> DataFrame:
    """Always the four cells, also when a class is absent."""
    s = predictions(scores, p)
    return s.groupBy(*by).agg(*confusion(F.col(y), F.col("pred")))


def classification_metrics(scores: DataFrame, by: Sequence[str] = ("target", "model"),
                           y: str = "y", p: str = "p") -> DataFrame:
    """E1, E2, E4 (+E3 cells): accuracy, precision, recall, F1, specificity,
    with 0 wherever a ratio is undefined (zero_division=0)."""
    s = predictions(scores, p)
    yy, pr = F.col(y), F.col("pred")
    agg = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *confusion(yy, pr))
    tn, fp, fn, tp = (F.col(c) for c in ("true_neg", "false_pos", "false_neg", "true_pos"))
    z = F.lit(0.0)
    return agg.select(
        *by, "n",
        ((tp + tn) / F.col("n")).alias("accuracy"),
        F.coalesce(div(tp, tp + fp), z).alias("precision"),
        F.coalesce(div(tp, tp + fn), z).alias("recall"),
        F.coalesce(div(2 * tp, 2 * tp + fp + fn), z).alias("f1"),
        F.coalesce(div(tn, tn + fp), z).alias("specificity"),
        "true_neg", "false_pos", "false_neg", "true_pos",
    )


def roc_auc(scores: DataFrame, by: Sequence[str] = ("target", "model"), y: str = "y",
            p: str = "p", ranges: int | None = None) -> DataFrame:
    """E5: exact ROC AUC per group; NULL unless both classes are present."""
    by = list(by)
    g = scores.groupBy(*by, F.col(p).alias("s")).agg(
        F.sum(F.col(y)).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    g = ranged(g, [*by, "s"], "auc", "rng", ranges)
    g = below(g, by, ["s"], F.col("neg"), "rng", "below")
    res = g.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("__num"),
        F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    auc = F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                 F.col("__num") / (F.col("__P").cast("double") * F.col("__N")))
    return res.select(*by, auc.alias("auc"))


def log_loss(scores: DataFrame, by: Sequence[str] = ("target", "model"), y: str = "y",
             p: str = "p") -> DataFrame:
    """Mean negative log-likelihood, p clipped to [eps, 1 - eps]; NULL
    unless both classes are present (as the reference computes it)."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - EPS)), F.lit(EPS))
    yy = F.col(y)
    ll = -(yy * F.log(q) + (1 - yy) * F.log(1 - q))
    res = scores.groupBy(*by).agg(F.avg(ll).alias("__ll"), F.countDistinct(yy).alias("__k"))
    return res.select(*by, F.when(F.col("__k") == 2, F.col("__ll")).alias("log_loss"))


def soft_vote(scores: DataFrame, members: Sequence[str], name: str = "ensemble",
              keys: Sequence[str] = ("target", "ticker", "date")) -> DataFrame:
    """Mean class-1 probability of the member models, for rows every
    member scored; appended as model ``name``."""
    keys = list(keys)
    m = scores.filter(F.col("model").isin(list(members)))
    vote = m.groupBy(*keys).agg(F.first("y").alias("y"), F.avg("p").alias("p"),
                                F.count(F.lit(1)).alias("__k"))
    vote = vote.filter(F.col("__k") == len(members)).drop("__k").withColumn("model", F.lit(name))
    return scores.unionByName(vote.select(scores.columns))


def results_table(scores: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """Accuracy, AUC (missing → 0) and F1 per (target, model), sorted
    by target, then AUC descending."""
    m = classification_metrics(scores, by).join(roc_auc(scores, by), list(by), "left")
    return (m.select(*by, "accuracy", F.coalesce("auc", F.lit(0.0)).alias("auc"), "f1")
            .orderBy("target", F.desc("auc"), "model"))


def best_per_target(results: DataFrame) -> DataFrame:
    """The model with the highest AUC per target (accuracy when no AUC)."""
    key = F.coalesce(F.col("auc"), F.col("accuracy"))
    w = Window.partitionBy("target").orderBy(key.desc(), F.col("model"))
    return results.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def avg_by(results: DataFrame, col: str) -> DataFrame:
    """Mean accuracy, AUC and F1 per model or per target."""
    return (results.groupBy(col).agg(*[F.avg(m).alias(m) for m in METRICS])
            .orderBy(F.desc("auc"), col))


def top_models(results: DataFrame, n: int = 5) -> DataFrame:
    """The n best (target, model) pairs by AUC."""
    return results.orderBy(F.desc("auc"), "target", "model").limit(n)


def results_pivot(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per metric, one row per target and one column per model (missing
    → 0), with the chart's padded value range (min / max -+ 10 % of range)."""
    stacked = results.select("target", "model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])))
    piv = stacked.groupBy("metric", "target").pivot("model", list(models)).agg(F.first("value"))
    piv = piv.na.fill(0.0, subset=list(models))
    rng = stacked.filter(F.col("model").isin(list(models))).groupBy("metric").agg(
        F.min("value").alias("__mn"), F.max("value").alias("__mx"))
    rng = rng.select("metric", (F.col("__mn") - (F.col("__mx") - F.col("__mn")) * 0.1).alias("y_min"),
                     (F.col("__mx") + (F.col("__mx") - F.col("__mn")) * 0.1).alias("y_max"))
    return piv.join(rng, "metric", "left")


def class_balance(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, target, label, n) for each label column, NULL labels skipped."""
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("target"), F.col(c).cast("int").alias("label")) for c in labels])))
    return long.filter(F.col("label").isNotNull()).groupBy(*by, "target", "label").agg(
        F.count(F.lit(1)).alias("n"))


def class_weights(balance: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Balanced weights n / (k * n_c) when min/max class ratio < ``ratio``
    (else 1), and scale_pos_weight = neg / pos under the same rule."""
    w = Window.partitionBy("target")
    b = balance.select(
        "target", "label", "n",
        F.sum("n").over(w).alias("__tot"), F.count(F.lit(1)).over(w).alias("k"),
        (F.min("n").over(w) / F.max("n").over(w)).alias("ratio"),
        F.sum(F.when(F.col("label") == 0, F.col("n"))).over(w).alias("__neg"),
        F.sum(F.when(F.col("label") == 1, F.col("n"))).over(w).alias("__pos"))
    imb = (F.col("k") == 2) & (F.col("ratio") < ratio)
    return b.select(
        "target", "label", "n", "ratio",
        F.when(imb, F.col("__tot") / (F.col("k") * F.col("n"))).otherwise(F.lit(1.0)).alias("weight"),
        F.when(imb & (F.col("__pos") > 0), F.col("__neg") / F.col("__pos")).otherwise(F.lit(1.0))
        .alias("scale_pos_weight"))


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Planned in the proposal: MAE, RMSE and R² of a continuous prediction,
    over rows where both are present; one aggregate pass."""
    both = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    err = F.col(y) - F.col(pred)
    res = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("__ssr"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("__sst"))
    return res.select(*by, "n", "mae", "rmse",
                      (1 - div(F.col("__ssr"), F.col("__sst"))).alias("r2"))
