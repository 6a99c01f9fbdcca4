"""Registered queries for filters, scaling, selection statistics, class
balance and evaluation (P, Z, F, T1-T3, T7, E)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import rnd
from panelforge.operators import evaluate as E
from panelforge.operators import filters as P
from panelforge.operators import scaling as Z
from panelforge.operators import selection as S
from panelforge.operators import windows as W
from panelforge.operators.labels import HORIZONS, labels, panel_labels
from panelforge.operators.mutual import mutual_info_neighbours
from panelforge.operators.xsection import xs_rank
from panelforge.plans.pipeline import SCALABLE, feature_columns
from panelforge.plans.queries import KEYS, LEVELS, engineered, framed, out, panel, query
from panelforge.session import checkpoint_dir
from panelforge.sources import io
from panelforge.sources.bars import benchmark_series, stock_panel

# Train / test cut of the fixture panel (FIXTURES.md §3) and the target the
# selection statistics are computed for.
CUT = "2000-01-01"
TARGET = "target_direction_21d"
SCORE_TARGETS = [(f"direction_{n}", h) for n, h in HORIZONS]
SCORE_MODELS = ["momentum", "reversal", "oscillator"]
ALL_MODELS = SCORE_MODELS + ["ensemble"]
# Columns of the redundancy heatmap (fixed values).
HEATMAP = ["macd_hist", "rsi_14", "volatility_21d", "price_to_sma200", "market_volatility",
           "volume_ratio", "beta", "target_return_21d"]


# ---------------------------------------------------------------- filters
@query("time_split")
def q_time_split(spark, sf_dir):
    """Each bar tagged train / test at the cut."""
    return P.tag_split(stock_panel(spark, sf_dir), CUT).select(*KEYS, "split")


@query("feature_projection")
def q_feature_projection(spark, sf_dir):
    """Keys + the 61 model features, by subtraction."""
    df = engineered(spark, sf_dir)
    return rnd(df.select(*KEYS, *feature_columns(df)), overrides=LEVELS)


@query("drop_unlabelled")
def q_drop_unlabelled(spark, sf_dir):
    """P5: rows whose 21-row label is known."""
    df = panel_labels(panel(spark, sf_dir))
    return P.drop_unlabelled(df, TARGET).select(*KEYS, TARGET)


def report_frame(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The feature-quality input: complete rows of the engineered panel and
    every non-raw, non-target column (raw levels included)."""
    df = engineered(spark, sf_dir)
    raw = {"ticker", "date", "open", "high", "low", "close", "adj_close", "volume"}
    feats = [c for c in df.columns if c not in raw and not c.startswith("target_")]
    return P.complete_cases(df), feats


@query("complete_cases")
def q_complete_cases(spark, sf_dir):
    """Rows of the engineered panel with no NULL anywhere."""
    df, _ = report_frame(spark, sf_dir)
    return df.select(*KEYS, "target_return_21d").transform(lambda d: rnd(d))


@query("fill_zero")
def q_fill_zero(spark, sf_dir):
    """All model inputs with NULL → 0."""
    df = engineered(spark, sf_dir)
    cols = feature_columns(df)
    return rnd(P.fill_zero(df.select(*KEYS, *cols), cols), overrides=LEVELS)


@query("sample_guard")
def q_sample_guard(spark, sf_dir):
    """P10: tickers with at least 10 training rows."""
    train, _ = P.time_split(stock_panel(spark, sf_dir), CUT)
    return P.sample_guard(train, ["ticker"], 10)


def _stock_universe(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("ticker"))


def _mixed_panel(spark, sf_dir) -> DataFrame:
    return io.union_panel(stock_panel(spark, sf_dir), benchmark_series(spark, sf_dir))


@query("universe_semi")
def q_universe_semi(spark, sf_dir):
    """Stock rows of the mixed panel (index rows out)."""
    return P.universe_semi(_mixed_panel(spark, sf_dir), _stock_universe(spark, sf_dir)).select(*KEYS, "close")


@query("universe_anti")
def q_universe_anti(spark, sf_dir):
    """Index rows of the mixed panel."""
    return P.universe_anti(_mixed_panel(spark, sf_dir), _stock_universe(spark, sf_dir)).select(*KEYS, "close")


# ---------------------------------------------------------------- scaling
@query("scaler_fit")
def q_scaler_fit(spark, sf_dir):
    """Per-ticker median / IQR of the 13 scaled features on train rows."""
    params = Z.fit_scaler(engineered(spark, sf_dir, cols=SCALABLE), SCALABLE, CUT)
    return rnd(params)


@query("robust_scale")
def q_robust_scale(spark, sf_dir):
    """Every row scaled with its ticker's training parameters."""
    scaled, _ = Z.robust_scale(engineered(spark, sf_dir, cols=SCALABLE), SCALABLE, CUT)
    return rnd(scaled.select(*KEYS, *SCALABLE))


@query("scaler_apply")
def q_scaler_apply(spark, sf_dir):
    """Parameters stored as Parquet in the checkpoint folder (a
    folder of their own for each call), read back and applied."""
    df = engineered(spark, sf_dir, cols=SCALABLE)
    path = f"{checkpoint_dir(spark)}/scaler_params-{uuid.uuid4().hex}"
    Z.save_params(Z.fit_scaler(df, SCALABLE, CUT), path)
    params = Z.load_params(spark, path)
    return rnd(Z.apply_scaler(df, params, SCALABLE).select(*KEYS, *SCALABLE))


@query("minmax_scale")
def q_minmax_scale(spark, sf_dir):
    """Numeric bar columns min-max scaled over the whole table."""
    df = panel(spark, sf_dir)
    cols = P.numeric_columns(df)
    return rnd(Z.minmax_scale(df, cols))


@query("binary_remap")
def q_binary_remap(spark, sf_dir):
    """A two-valued label remapped to 0/1 and a continuous target min-max scaled."""
    df = panel_labels(panel(spark, sf_dir), mode="reference").select(*KEYS, "target_direction_21d", "target_return_21d")
    return rnd(Z.binary_remap(Z.binary_remap(df, "target_direction_21d"), "target_return_21d"))


# ---------------------------------------------------------------- selection statistics
def train_frame(spark, sf_dir, target: str = TARGET) -> tuple[DataFrame, list[str]]:
    """Training rows for one target: labelled, before the cut, features → 0."""
    df = engineered(spark, sf_dir)
    feats = feature_columns(df)
    train, _ = P.time_split(P.drop_unlabelled(df, target), CUT)
    return P.fill_zero(train.select(*KEYS, *feats, target), feats), feats


@query("corr_with_target")
def q_corr_with_target(spark, sf_dir):
    """top 15 |corr| with the 21-row forward return on complete rows."""
    df, feats = report_frame(spark, sf_dir)
    return rnd(S.corr_with_target(df, feats, "target_return_21d", top=15))


@query("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    """lower triangle of the heatmap's correlation matrix."""
    return rnd(S.corr_matrix(engineered(spark, sf_dir, cols=HEATMAP), HEATMAP))


@query("corr_matrix_all")
def q_corr_matrix_all(spark, sf_dir):
    """pairwise-complete correlations of all 61 features."""
    df = engineered(spark, sf_dir)
    return rnd(S.corr_matrix(df, feature_columns(df)))


@query("variance_filter")
def q_variance_filter(spark, sf_dir):
    """features with population variance > 0.01."""
    df, feats = train_frame(spark, sf_dir)
    return rnd(S.variance_filter(df, feats, 0.01))


@query("correlation_filter")
def q_correlation_filter(spark, sf_dir):
    """features left after dropping those an earlier one tracks at |r| > 0.95."""
    df, feats = train_frame(spark, sf_dir)
    df = df.checkpoint()
    return S.correlation_filter(df, feats, 0.95)


@query("mutual_info_topk")
def q_mutual_info_topk(spark, sf_dir):
    """top 30 features by binned mutual information with the label."""
    df, feats = train_frame(spark, sf_dir)
    return rnd(S.top_by(S.mutual_info(df, feats, TARGET, bins=10), "mi", 30))


@query("mutual_info_neighbours")
def q_mutual_info_neighbours(spark, sf_dir):
    """mutual information of every feature with the label by nearest
    neighbours. The features are rounded as in ``feature_projection``, so that
    ties are the same in every engine."""
    df, feats = train_frame(spark, sf_dir)
    return rnd(mutual_info_neighbours(rnd(df, overrides=LEVELS), feats, TARGET))


@query("selection_intersect")
def q_selection_intersect(spark, sf_dir):
    """Variance survivors that are also in the mutual-information top 30."""
    df, feats = train_frame(spark, sf_dir)
    a = S.variance_filter(df, feats, 0.01)
    b = S.top_by(S.mutual_info(df, feats, TARGET, bins=10), "mi", 30)
    return S.intersect_selections(a, b)


@query("class_balance")
def q_class_balance(spark, sf_dir):
    """Label counts of the six targets in the training and test periods."""
    df = P.tag_split(panel_labels(panel(spark, sf_dir)), CUT)
    return E.class_balance(df, [c for c in df.columns if c.startswith("target_direction_")], by=["split"])


@query("class_weights")
def q_class_weights(spark, sf_dir):
    """Balanced class weights and scale_pos_weight per target."""
    df = panel_labels(panel(spark, sf_dir))
    train, _ = P.time_split(df, CUT)
    bal = E.class_balance(train, [c for c in df.columns if c.startswith("target_direction_")])
    return rnd(E.class_weights(bal, 0.7))


# ---------------------------------------------------------------- evaluation on a fixed score table
def score_table(spark, sf_dir) -> DataFrame:
    """(target, model, ticker, date, y, p) on the test period: three rule
    "models" (momentum rank, its reverse, RSI / 100) and the six label horizons."""
    hz = HORIZONS

    def frames(d, w):
        return labels(W.rsi(W.pct_change(d, "adj_close", [21], w), w, periods=[14]), w, horizons=hz)

    df = xs_rank(framed(spark, sf_dir, frames, 22, 252), ["return_21d"])
    _, test = P.time_split(df, CUT)
    p = {"momentum": F.col("return_21d_rank"), "reversal": 1 - F.col("return_21d_rank"),
         "oscillator": F.col("rsi_14") / 100}
    rows = [F.struct(F.lit(f"direction_{n}").alias("target"), F.lit(m).alias("model"),
                     F.col(f"target_direction_{n}").alias("y"), p[m].alias("p"))
            for n, _ in hz for m in SCORE_MODELS]
    s = test.select("ticker", "date", F.inline(F.array(*rows)))
    return s.filter(F.col("y").isNotNull() & F.col("p").isNotNull()).select(
        "target", "model", "ticker", "date", "y", "p")


def scores(spark, sf_dir) -> DataFrame:
    """The score table with its ensemble rows: the table is stored before the
    vote reads it twice, and again with the vote, as every metric query reads
    it in several branches."""
    s = io.stage(score_table(spark, sf_dir), "scores")
    return io.stage(E.soft_vote(s, SCORE_MODELS), "voted")


@query("soft_vote")
def q_soft_vote(spark, sf_dir):
    """The ensemble rows (mean member probability)."""
    return rnd(scores(spark, sf_dir).filter(F.col("model") == "ensemble"))


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    """E1/E2/E4."""
    return rnd(E.classification_metrics(scores(spark, sf_dir)))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    """E3."""
    return E.confusion_matrix(scores(spark, sf_dir))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    """E5: exact ROC AUC per (target, model)."""
    return rnd(E.roc_auc(scores(spark, sf_dir)))


@query("log_loss")
def q_log_loss(spark, sf_dir):
    """E6."""
    return rnd(E.log_loss(scores(spark, sf_dir)))


def results(spark, sf_dir) -> DataFrame:
    """The (target, model) result table, checkpointed (a few dozen rows that
    several report queries read twice)."""
    return E.results_table(scores(spark, sf_dir)).checkpoint()


@query("results_table")
def q_results_table(spark, sf_dir):
    """E13."""
    return rnd(results(spark, sf_dir))


@query("best_per_target")
def q_best_per_target(spark, sf_dir):
    """E9."""
    return rnd(E.best_per_target(results(spark, sf_dir)))


@query("avg_by_model")
def q_avg_by_model(spark, sf_dir):
    """E10."""
    return rnd(E.avg_by(results(spark, sf_dir), "model"))


@query("avg_by_target")
def q_avg_by_target(spark, sf_dir):
    """E11."""
    return rnd(E.avg_by(results(spark, sf_dir), "target"))


@query("top_models")
def q_top_models(spark, sf_dir):
    """The five best (target, model) pairs by AUC."""
    return rnd(E.top_models(results(spark, sf_dir), 5))


@query("results_pivot")
def q_results_pivot(spark, sf_dir):
    """E14."""
    return rnd(E.results_pivot(results(spark, sf_dir), ALL_MODELS))


@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    """MAE / RMSE / R² of a persistence forecast (past h-row return as the
    next h-row return) per horizon, on the test period."""
    hz = [(f"{h}d", h) for _, h in HORIZONS]

    def frames(d, w):
        return labels(W.pct_change(d, "adj_close", [h for _, h in hz], w), w, horizons=hz)

    df = framed(spark, sf_dir, frames, 252, 252)
    _, test = P.time_split(df, CUT)
    long = test.select(F.inline(F.array(*[
        F.struct(F.lit(f"return_{n}").alias("target"), F.col(f"target_return_{n}").alias("y"),
                 F.col(f"return_{n}").alias("pred")) for n, _ in hz])))
    return rnd(E.regression_metrics(long, "y", "pred", ["target"]))
