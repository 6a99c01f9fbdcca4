"""Spark ML training, tree-based selection and batch scoring (T4-T10, F7-F9,
F11, E7, S10).

The reference's three boosting libraries are re-aimed at Spark ML families:
gradient-boosted trees (its main model, same depth / rate / sampling), a
random forest and an elastic-net logistic regression. Importances are Spark's
gain-based ``featureImportances``. Features are assembled once into a stored
vector table that selection and all families read (a subset of the features is
a slice of the vector); the fits of all targets go through a queue (``fits``)
that runs them side by side and stores each one as it ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.evaluate import class_balance, class_weights
from panelforge.operators.fits import Fit, run_each, run_fits, workers
from panelforge.session import checkpoint_dir
from panelforge.sources.io import publish, published, stage

SEED = 42
FAMILIES = ("gbt", "rf", "lr")
# Features kept per target (the reference's per-horizon counts, fixed values).
N_FEATURES = {"direction_1d": 30, "direction_5d": 35, "direction_21d": 40,
              "direction_3m": 40, "direction_6m": 35, "direction_12m": 30}


# Rows of the vector table per task: a boosted tree runs a job per level, so
# many tiny tasks would be all overhead; beyond MOST_ROWS a task's rows would
# no longer fit beside others. Fits that run side by side share the cores: a
# task more than a fit's share of them waits for other fits.
ROWS_PER_TASK, MOST_ROWS = 20_000, 2_000_000


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def vectors(df: DataFrame, features: Sequence[str], keep: Sequence[str], side_by_side: int = 1) -> DataFrame:
    """Stored (keep..., all): the features as one vector, NULL as 0; read in as
    few tasks as one of ``side_by_side`` fits can use."""
    data = df.select(*keep, *features).fillna(0.0, subset=list(features))
    tasks = vector_tasks(df.count(), df.sparkSession.sparkContext.defaultParallelism, side_by_side)
    vec = assembler(features, "all").transform(data).select(*keep, "all")
    return stage(vec.repartition(tasks), "vectors").coalesce(tasks)


def vector_tasks(rows: int, cores: int, side_by_side: int = 1) -> int:
    """As many tasks as keep a fit's share of the cores busy, each with at least
    ROWS_PER_TASK rows, and at most MOST_ROWS."""
    return max(1, min(-(-rows // ROWS_PER_TASK), cores // side_by_side), -(-rows // MOST_ROWS))


def sliced(vec: DataFrame, features: Sequence[str], some: Sequence[str]) -> DataFrame:
    """The vector table with a ``features`` column of the listed features."""
    at = {f: i for i, f in enumerate(features)}
    return VectorSlicer(inputCol="all", outputCol="features", indices=[at[f] for f in some]).transform(vec)


def classifier(family: str, label: str, rounds: int = 300, weight: str | None = None):
    """The three families with the reference's boosting settings."""
    kw = {"labelCol": label, "featuresCol": "features"}
    if weight:
        kw["weightCol"] = weight
    if family == "gbt":
        return GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
                             featureSubsetStrategy="0.8", seed=SEED, **kw)
    if family == "rf":
        return RandomForestClassifier(numTrees=100, maxDepth=4, subsamplingRate=0.8,
                                      featureSubsetStrategy="0.8", seed=SEED, **kw)
    if family == "lr":
        return LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=0.1, **kw)
    raise ValueError(family)


def with_weights(df: DataFrame, label: str, ratio: float = 0.7) -> tuple[DataFrame, str | None]:
    """Balanced weights (``evaluate.class_weights``) for a two-class label."""
    rows = class_weights(class_balance(df, [label]), ratio).limit(3).collect()
    if len(rows) != 2 or all(r["weight"] == 1.0 for r in rows):
        return df, None
    w = F.when(F.col(label) == rows[0]["label"], rows[0]["weight"]).otherwise(rows[1]["weight"])
    return df.withColumn("__w", w), "__w"


def fit_vectors(vec: DataFrame, features: Sequence[str], some: Sequence[str], label: str, family: str,
                rounds: int = 300, weighted: bool = True) -> PipelineModel:
    """Fit one family on a slice of the vector table; the model takes raw
    columns (its first stage assembles ``some``)."""
    data, wcol = with_weights(vec, label) if weighted else (vec, None)
    m = classifier(family, label, rounds, wcol).fit(sliced(data, features, some))
    return PipelineModel(stages=[assembler(some), m])


def fit_model(df: DataFrame, features: Sequence[str], label: str, family: str,
              rounds: int = 300, weighted: bool = True) -> PipelineModel:
    """Assemble, store and fit one classifier; NULL features count as 0."""
    return fit_vectors(vectors(df, features, [label]), features, features, label, family, rounds, weighted)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Class-1 probability for every row (features NULL → 0)."""
    out = model.transform(df.fillna(0.0, subset=list(features)))
    return out.select(*keep, vector_to_array("probability")[1].alias("p"))


def _ranked(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance), best first, ties by name: one row a feature."""
    imp = [float(v) for v in model.featureImportances.toArray()]
    return sorted(zip(features, imp), key=lambda x: (-x[1], x[0]))


def _booster(label: str, rounds: int, task: str):
    kw = {"labelCol": label, "featuresCol": "features", "maxIter": rounds, "maxDepth": 5, "seed": SEED}
    return GBTClassifier(**kw) if task == "classification" else GBTRegressor(**kw)


def top_features(vec: DataFrame, features: Sequence[str], some: Sequence[str], label: str, n: int,
                 rounds: int = 100, task: str = "classification") -> list[tuple[str, float]]:
    m = _booster(label, rounds, task).fit(sliced(vec, features, some))
    return _ranked(m, some)[:n]


def importance_topk(df: DataFrame, features: Sequence[str], label: str, n: int,
                    rounds: int = 100) -> DataFrame:
    """top n features by boosted-tree importance (100 trees of depth 5)."""
    top = top_features(vectors(df, features, [label]), features, features, label, n, rounds)
    return df.sparkSession.createDataFrame(top, "feature string, importance double")


def rfe_list(vec: DataFrame, features: Sequence[str], some: Sequence[str], label: str, n: int, step: int = 5,
             trees: int = 50, depth: int = 5, task: str = "classification") -> list[str]:
    """Recursive elimination with a forest: drop the ``step`` weakest per round
    (fewer in the last) until n remain. Each round is one distributed fit on a
    slice of the stored vectors."""
    keep = list(some)
    forest = RandomForestClassifier if task == "classification" else RandomForestRegressor
    while len(keep) > n:
        m = forest(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                   seed=SEED).fit(sliced(vec, features, keep))
        imp = m.featureImportances.toArray().tolist()
        order = sorted(range(len(keep)), key=lambda i: (imp[i], keep[i]))
        gone = {keep[i] for i in order[:min(step, len(keep) - n)]}
        keep = [f for f in keep if f not in gone]
    return keep


def rfe(df: DataFrame, features: Sequence[str], label: str, n: int, step: int = 5,
        trees: int = 50, depth: int = 5) -> DataFrame:
    """F8: recursive feature elimination."""
    keep = rfe_list(vectors(df, features, [label]), features, features, label, n, step, trees, depth)
    return df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(keep)], "feature string, position int")


def rf_importance(df: DataFrame, features: Sequence[str], target: str,
                  trees: int = 50, depth: int = 10, folder: str | None = None) -> DataFrame:
    """random-forest regression importances. The fitted ones are stored
    under ``folder`` by the content of the rows, so reports that need the same
    ones fit once."""
    spark = df.sparkSession
    vec = vectors(df, features, [target])

    def run():
        rf = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED)
        return _ranked(rf.fit(sliced(vec, features, features)), features)

    def save(ranked, path):
        spark.createDataFrame(ranked, "feature string, importance double").write.mode("overwrite").parquet(f"{path}/list")

    def load(path):
        rows = spark.read.parquet(f"{path}/list").collect()      # one row a feature
        return sorted(((r["feature"], r["importance"]) for r in rows), key=lambda x: (-x[1], x[0]))

    fit = Fit(f"forest_{target}", run, save, load,
              {"rows": content(vec), "features": list(features), "trees": trees, "depth": depth})
    ranked = run_fits(spark, [fit], folder or f"{checkpoint_dir(spark)}/fits", 1)[fit.name]
    return spark.createDataFrame(ranked, "feature string, importance double")


def content(vec: DataFrame) -> list[int]:
    """Rows of a vector table and an order-free hash over all of them."""
    cols = [vector_to_array(c) if c == "all" else F.col(c) for c in vec.columns]
    return list(vec.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*cols))).first())


def save_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int") \
        .write.mode("overwrite").parquet(path)


def load_list(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in spark.read.parquet(path).orderBy("position").collect()]


def target_fits(vec: DataFrame, features: Sequence[str], name: str, n_features: int, families: Sequence[str],
                rounds: int, select_rounds: int, params: dict) -> list[Fit]:
    """T8 for one target: importance selection, then one fit per family, all
    from the labelled rows of the vector table."""
    spark, label = vec.sparkSession, f"target_{name}"
    data = vec.filter(F.col(label).isNotNull())
    made = {**params, "target": name, "n": n_features, "select_rounds": select_rounds}
    fits = [Fit(f"select_{name}",
                lambda: [f for f, _ in top_features(data, features, features, label, n_features, select_rounds)],
                lambda sel, path: save_list(spark, sel, path + "/list"), lambda path: load_list(spark, path + "/list"),
                made, weight=2e4)]
    for fam in families:
        fits.append(Fit(f"{name}_{fam}",
                        lambda sel, fam=fam: fit_vectors(data, features, sel, label, fam, rounds),
                        lambda m, path: m.write().overwrite().save(path + "/model"),
                        lambda path: PipelineModel.load(path + "/model"),
                        {**made, "family": fam, "rounds": rounds}, (f"select_{name}",),
                        weight=1e4 if fam == "gbt" else 1.0))
    return fits


def enough_rows(df: DataFrame, targets: Sequence[str], least: int) -> list[str]:
    """P10: the targets with at least ``least`` labelled rows (one aggregate)."""
    n = df.agg(*[F.count(f"target_{t}").alias(t) for t in targets]).first()
    return [t for t in targets if n[t] >= least]


def train_all(train: DataFrame, features: Sequence[str], targets: dict[str, int],
              families: Sequence[str] = FAMILIES, rounds: int = 300, min_rows: int = 1000,
              side_by_side: int | None = None, select_rounds: int = 100,
              folder: str | None = None) -> dict[str, tuple[list[str], dict[str, PipelineModel]]]:
    """Fit every target with enough labelled rows, side by side.

    Outcomes are stored under ``folder`` (one in the shared checkpoint folder by
    default) as they come, named after the settings and the content of the
    training rows: a run that starts again on the same rows loads what is there
    and fits only what is missing."""
    names = enough_rows(train, list(targets), min_rows)
    if not names:
        return {}
    spark = train.sparkSession
    vec = vectors(train, features, [f"target_{t}" for t in names], len(names))
    made = {"rows": content(vec), "features": list(features)}
    fits = [f for t in names for f in target_fits(vec, features, t, targets[t], families, rounds, select_rounds, made)]
    tasks = vec.rdd.getNumPartitions()
    got = run_fits(spark, fits, folder or f"{checkpoint_dir(spark)}/fits",
                   side_by_side or workers(spark, tasks, len(fits)))
    return {t: (got[f"select_{t}"], {fam: got[f"{t}_{fam}"] for fam in families}) for t in names}


def scores_long(models: dict, test: DataFrame, keys: Sequence[str], min_rows: int = 100) -> DataFrame:
    """One stored score table (target, model, keys, y, p) plus the
    soft-vote ensemble of the fitted families; targets with fewer than
    ``min_rows`` labelled rows are left out (P10).

    The rows are assembled once into a stored vector table of the features
    that any target selected; every model reads its slice of it."""
    from panelforge.operators.evaluate import soft_vote
    names = enough_rows(test, list(models), min_rows)
    if not names:
        raise ValueError(f"no target has {min_rows} labelled rows to score")
    used = list(dict.fromkeys(f for name in names for f in models[name][0]))
    vec = vectors(test, used, [*keys, *[f"target_{t}" for t in names]])
    parts = []
    for name in names:
        label = f"target_{name}"
        sel, fams = models[name]
        data = sliced(vec.filter(F.col(label).isNotNull()).select(*keys, label, "all"), used, sel)
        for fam, m in fams.items():
            s = m.stages[-1].transform(data)
            parts.append(s.select(F.lit(name).alias("target"), F.lit(fam).alias("model"), *keys,
                                  F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stage(out, "model_scores")
    fams = sorted({f for _, fs in models.values() for f in fs})
    return soft_vote(out, fams, keys=["target", *keys]) if len(fams) > 1 else out


def save_models(models: dict, path: str, spark: SparkSession) -> str:
    """One version of all artefacts under ``path``: a PipelineModel per
    (target, family) and the table of selected features. The version is
    written beside what is there and published last, by one atomic rename of
    its pointer, so readers see a whole old or a whole new set. Returns its
    folder."""
    version = f"{path}/version-{uuid.uuid4().hex}"
    run_each(spark, lambda m, to: m.write().save(to),
             [(m, f"{version}/{name}_{fam}") for name, (_, fams) in models.items() for fam, m in fams.items()])
    rows = [(name, fam, f, i) for name, (sel, fams) in models.items() for fam in fams for i, f in enumerate(sel)]
    spark.createDataFrame(rows, "target string, family string, feature string, position int") \
        .write.parquet(f"{version}/selected_features")
    publish(spark, path, version)
    return version


def load_model(path: str, name: str, family: str) -> PipelineModel:
    """One model of the published version."""
    version = published(SparkSession.getActiveSession(), path)
    if version is None:
        raise ValueError(f"nothing is published under {path}")
    return PipelineModel.load(f"{version}/{name}_{family}")


def load_models(path: str, spark: SparkSession) -> dict[str, tuple[list[str], dict[str, PipelineModel]]]:
    """The published version: target -> (features, family -> model)."""
    version = published(spark, path)
    if version is None:
        raise ValueError(f"nothing is published under {path}")
    sel: dict[str, tuple[list[str], dict[str, PipelineModel]]] = {}
    rows = spark.read.parquet(f"{version}/selected_features").orderBy("target", "family", "position").collect()
    named = list(dict.fromkeys((r["target"], r["family"]) for r in rows))
    loaded = run_each(spark, PipelineModel.load, [(f"{version}/{name}_{fam}",) for name, fam in named])
    models = dict(zip(named, loaded))
    for r in rows:      # one row a selected feature and family
        feats, fams = sel.setdefault(r["target"], ([], {}))
        fams[r["family"]] = models[r["target"], r["family"]]
        if r["feature"] not in feats:
            feats.append(r["feature"])
    return sel
