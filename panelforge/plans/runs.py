"""End-to-end train and test runs over stored stages.

Each stage is a Parquet table under one output folder; a finished stage of the
same inputs and cut is read back instead of rebuilt (``read_or_build``), which
also makes a re-run after a failure resume from the last finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import evaluate as E
from panelforge.operators import scaling as Z
from panelforge.operators import train as T
from panelforge.operators.filters import tag_split, time_split
from panelforge.operators.labels import purge_labels
from panelforge.plans.pipeline import SCALABLE, engineer_features, feature_columns
from panelforge.sources.io import read_or_build, stage_path, write_stage

KEYS = ["ticker", "date"]


def _inputs(bars: DataFrame) -> dict:
    """What a stage depends on: the input files (or, without any, the plan) and
    the columns."""
    files = sorted(bars.inputFiles())
    return {"files": files or str(bars.semanticHash()), "columns": bars.dtypes}


def run_train(spark: SparkSession, bars: DataFrame, out: str, cut: str,
              rounds: int = 300, families=T.FAMILIES, select_rounds: int = 100,
              min_rows: int = 1000, purged: bool = False) -> dict:
    """Engineer -> scale (fit on rows before ``cut``) -> train every target.

    Stages written: ``engineered-...``, ``scaler-...``, ``normalized-...``
    (named after what they depend on), ``models``, ``class_distribution`` of
    the training and test periods, ``fits`` (each model as it ends) and
    ``current`` (where ``run_test`` finds the normalized panel). ``models`` holds
    versions; the published one is replaced whole. ``purged`` leaves labels out of training that look
    at prices from ``cut`` on.
    """
    made = _inputs(bars)
    eng = read_or_build(spark, f"{out}/engineered", lambda: engineer_features(bars), params=made)
    made = {**made, "cut": cut}
    params = read_or_build(spark, f"{out}/scaler", lambda: Z.fit_scaler(eng, SCALABLE, cut), params=made)
    norm = read_or_build(spark, f"{out}/normalized", lambda: Z.apply_scaler(eng, params, SCALABLE), params=made)
    write_stage(spark.createDataFrame([("normalized", stage_path(f"{out}/normalized", made))], "stage string, path string"),
                f"{out}/current")
    feats = feature_columns(norm)
    train, _ = time_split(norm, cut)
    if purged:
        train = purge_labels(norm, cut)
    models = T.train_all(train, feats, T.N_FEATURES, families, rounds, min_rows,
                         select_rounds=select_rounds, folder=f"{out}/fits")
    T.save_models(models, f"{out}/models", spark)
    balance = E.class_balance(tag_split(norm, cut), [f"target_{t}" for t in T.N_FEATURES], by=["split"])
    write_stage(balance, f"{out}/class_distribution")
    return models


def run_test(spark: SparkSession, out: str, cut: str, families=T.FAMILIES) -> DataFrame:
    """Score the stored models on rows from ``cut`` on; returns the result
    table (target, model, accuracy, auc, f1), also written to ``results``."""
    path = spark.read.parquet(f"{out}/current").first()["path"]
    norm = spark.read.parquet(path)
    _, test = time_split(norm, cut)
    models = {t: (feats, {f: m for f, m in fams.items() if f in families})
              for t, (feats, fams) in T.load_models(f"{out}/models", spark).items()}
    scores = T.scores_long(models, test, KEYS)
    results = E.results_table(scores)
    write_stage(results, f"{out}/results")
    return spark.read.parquet(f"{out}/results")
