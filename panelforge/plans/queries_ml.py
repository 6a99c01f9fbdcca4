"""Registered Spark ML queries (rows-only checks: fitted models are not SQL).

They use the reference's fast mode (T10: 150 boosting rounds, no ensemble
refit) and the 21-row direction target unless the operator itself spans all
targets (``train_all``); ``train_gbt_full`` is the 300-round mode.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import rnd
from panelforge.operators import evaluate as E
from panelforge.operators import filters as P
from panelforge.operators import selection as S
from panelforge.operators import train as T
from panelforge.operators.selector import FeatureSelector
from panelforge.plans.pipeline import feature_columns
from panelforge.plans.queries import KEYS, LEVELS, engineered, query
from panelforge.plans.queries_stats import CUT, report_frame
from panelforge.session import checkpoint_dir
from panelforge.sources import io

FAST_ROUNDS = 150
NAME = "direction_21d"
LABEL = f"target_{NAME}"


def split_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    """Checkpointed engineered panel split at the cut: the training stages
    re-read it many times, and the checkpoint cuts the window lineage."""
    df = engineered(spark, sf_dir)
    feats = feature_columns(df)
    train, test = P.time_split(df, CUT)
    return train, test, feats


def _family_scores(spark, sf_dir, family: str, rounds: int = FAST_ROUNDS) -> DataFrame:
    train, test, feats = split_frames(spark, sf_dir)
    data = train.filter(F.col(LABEL).isNotNull())
    m = T.fit_model(data, feats, LABEL, family, rounds)
    t = test.filter(F.col(LABEL).isNotNull())
    s = T.score(m, t, feats, [*KEYS, F.col(LABEL).cast("int").alias("y")])
    return rnd(s.select(F.lit(NAME).alias("target"), F.lit(family).alias("model"), *KEYS, "y", "p"))


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    """Boosted trees (depth 4, rate 0.05, 0.8 row / column sampling)."""
    return _family_scores(spark, sf_dir, "gbt")


@query("train_gbt_full")
def q_train_gbt_full(spark, sf_dir):
    """T4: boosted trees with the full 300 rounds."""
    return _family_scores(spark, sf_dir, "gbt", 300)


@query("train_rf")
def q_train_rf(spark, sf_dir):
    """T5 (re-aimed): random forest."""
    return _family_scores(spark, sf_dir, "rf")


@query("train_lr")
def q_train_lr(spark, sf_dir):
    """T6 (re-aimed): elastic-net logistic regression."""
    return _family_scores(spark, sf_dir, "lr")


def _all_models(spark, sf_dir) -> tuple[dict, DataFrame, DataFrame]:
    """Fitted models of all targets and families, with both periods. Fits that
    another query of this folder has stored are loaded."""
    train, test, feats = split_frames(spark, sf_dir)
    return T.train_all(train, feats, T.N_FEATURES, rounds=FAST_ROUNDS), train, test


@query("train_all")
def q_train_all(spark, sf_dir):
    """T8/T9/P10 + E13: every target (per-target feature counts), three
    families and their soft vote; accuracy, AUC and F1 in sample (``train``)
    and out of time (``test``)."""
    models, train, test = _all_models(spark, sf_dir)
    parts = [E.results_table(io.stage(T.scores_long(models, df, KEYS), "voted")).withColumn("sample", F.lit(name))
             for name, df in (("train", train), ("test", test))]
    return rnd(parts[0].unionByName(parts[1]))


@query("train_all_rows")
def q_train_all_rows(spark, sf_dir):
    """Rows and positive labels that each model and the vote scored in
    both periods, and how many probabilities lie outside 0 to 1."""
    models, train, test = _all_models(spark, sf_dir)
    parts = [T.scores_long(models, df, KEYS).groupBy("target", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"),
        F.sum(F.when(F.col("p").between(0, 1), 0).otherwise(1)).alias("outside")).withColumn("sample", F.lit(name))
        for name, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


@query("importance_topk")
def q_importance_topk(spark, sf_dir):
    """top 40 features by boosted-tree importance."""
    train, _, feats = split_frames(spark, sf_dir)
    return rnd(T.importance_topk(train.filter(F.col(LABEL).isNotNull()), feats, LABEL, 40))


@query("rfe")
def q_rfe(spark, sf_dir):
    """F8: recursive feature elimination down to 30 features, step 5."""
    train, _, feats = split_frames(spark, sf_dir)
    return T.rfe(train.filter(F.col(LABEL).isNotNull()), feats, LABEL, 30)


@query("select_features")
def q_select_features(spark, sf_dir):
    """F9 'all': features of enough variance, not correlated with an earlier one,
    in the top 30 by mutual information and by importance."""
    train, _, feats = split_frames(spark, sf_dir)
    return FeatureSelector("all", 30).fit(train, feats, LABEL).table(spark)


def _select(spark, sf_dir, method: str, n: int | None = 30) -> DataFrame:
    train, _, feats = split_frames(spark, sf_dir)
    return FeatureSelector(method, n or len(feats), estimator="bins").fit(train, feats, LABEL).table(spark).select("feature")


@query("select_variance")
def q_select_variance(spark, sf_dir):
    """F9 'variance', without a limit of their number."""
    return _select(spark, sf_dir, "variance", None)


@query("select_correlation")
def q_select_correlation(spark, sf_dir):
    """F9 'correlation', without a limit of their number."""
    return _select(spark, sf_dir, "correlation", None)


@query("select_mutual_info")
def q_select_mutual_info(spark, sf_dir):
    """F9 'mutual_info', in bins."""
    return _select(spark, sf_dir, "mutual_info")


@query("select_neighbours")
def q_select_neighbours(spark, sf_dir):
    """F9 'mutual_info', by nearest neighbours, features rounded as in
    ``feature_projection``."""
    train, _, feats = split_frames(spark, sf_dir)
    return FeatureSelector("mutual_info", 30).fit(rnd(train, overrides=LEVELS), feats, LABEL).table(spark).select("feature")


@query("rf_importance")
def q_rf_importance(spark, sf_dir):
    """forest regression importances for the 21-row forward return."""
    df, feats = report_frame(spark, sf_dir)
    return rnd(T.rf_importance(df, feats, "target_return_21d"))


def _report(spark, sf_dir) -> DataFrame:
    df, feats = report_frame(spark, sf_dir)
    corrs = S.corr_with_target(df, feats, "target_return_21d", top=None)
    return S.feature_report(corrs, T.rf_importance(df, feats, "target_return_21d"))


@query("feature_report")
def q_feature_report(spark, sf_dir):
    """|corr| and forest importance per feature."""
    return rnd(_report(spark, sf_dir))


@query("feature_top20")
def q_feature_top20(spark, sf_dir):
    """The 20 features with the largest forest importance."""
    return rnd(_report(spark, sf_dir).orderBy(F.desc("importance"), "feature").limit(20))


@query("feature_duel")
def q_feature_duel(spark, sf_dir):
    """sma_20 (raw level) against price_to_sma20 (ratio) in the report."""
    return rnd(S.feature_duel(_report(spark, sf_dir)))


def _stored(spark, sf_dir) -> tuple[dict, dict, DataFrame]:
    """All fitted models, the same read back from their published version, and
    the test period."""
    models, _, test = _all_models(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    T.save_models(models, path, spark)
    return models, T.load_models(path, spark), test


@query("feature_report_rows")
def q_feature_report_rows(spark, sf_dir):
    """The report's features with |corr|, whether an importance of 0
    to 1 is mapped to each, and the sum of all importances (1)."""
    r = io.stage(_report(spark, sf_dir), "report")
    total = r.agg(F.round(F.sum("importance"), 6).alias("total"))
    return rnd(r.select("feature", "abs_corr", F.col("importance").between(0, 1).alias("mapped"))
               .crossJoin(F.broadcast(total)))      # one row


@query("feature_duel_rows")
def q_feature_duel_rows(spark, sf_dir):
    """the two forms side by side, with |corr|."""
    return rnd(S.feature_duel(_report(spark, sf_dir)).select("feature", "form", "abs_corr"))


@query("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Fit, save, load, rescore, for every target and family; the largest
    probability difference between the fitted and the reloaded model (0 when
    the roundtrip is exact)."""
    models, loaded, test = _stored(spark, sf_dir)
    a = T.scores_long(models, test, KEYS)
    b = T.scores_long(loaded, test, KEYS).withColumnRenamed("p", "p2").drop("y")
    return a.join(b, ["target", "model", *KEYS]).groupBy("target", "model").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("p2"))).alias("max_abs_diff"))


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """The published models of all targets and families, and their vote,
    scored on the test period with each target's own selected features."""
    _, loaded, test = _stored(spark, sf_dir)
    return rnd(T.scores_long(loaded, test, KEYS))


@query("score_batch_rows")
def q_score_batch_rows(spark, sf_dir):
    """The rows that ``score_batch`` scores, with their labels."""
    _, loaded, test = _stored(spark, sf_dir)
    return T.scores_long(loaded, test, KEYS).select("target", "model", *KEYS, "y", F.col("p").between(0, 1).alias("valid"))
