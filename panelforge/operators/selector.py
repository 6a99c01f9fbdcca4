"""Feature selection as one object (F9, F10): fit, keep the selection, project.

Methods: ``variance``, ``correlation``, ``mutual_info``, ``importance``, ``rfe``
and ``all``. ``all`` drops columns of low variance, then correlated ones; from
what is left it makes two lists of n, by mutual information and by importance,
and keeps the features that are in both. Whatever the method, a selection of
more than n is cut to n by importance. ``task`` is ``classification`` (mutual
information by nearest neighbours, or in bins) or ``regression`` (the target in
equal-width bins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import selection as S
from panelforge.operators import train as T
from panelforge.operators.filters import fill_zero
from panelforge.operators.mutual import mutual_info_neighbours
from panelforge.sources.io import stage

METHODS = ("variance", "correlation", "mutual_info", "importance", "rfe", "all")


class FeatureSelector:
    """Select up to ``n`` of the feature columns for a label column."""

    def __init__(self, method: str = "all", n: int = 30, task: str = "classification",
                 variance: float = 0.01, correlation: float = 0.95, bins: int = 10, rounds: int = 100,
                 estimator: str = "neighbours"):
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if task not in ("classification", "regression"):
            raise ValueError("task must be classification or regression")
        if estimator not in ("neighbours", "bins"):
            raise ValueError("estimator must be neighbours or bins")
        self.method, self.n, self.task, self.estimator = method, n, task, estimator
        self.variance, self.correlation, self.bins, self.rounds = variance, correlation, bins, rounds
        self.selected: list[str] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "FeatureSelector":
        """Rows without a label are left out, NULL features count as 0, the
        label itself is never a feature. Only
        names and one number a feature come to the driver."""
        features = [f for f in features if f != label]
        data = fill_zero(df.filter(F.col(label).isNotNull()).select(*features, label), features)
        data = stage(data, "selection")
        sel = list(features)
        if self.method == "all":
            sel = self._correlation(data, self._variance(data, sel, label), label)
            by_mi, by_importance = (set(step(data, sel, label)) for step in (self._mutual_info, self._importance))
            sel = [f for f in sel if f in by_mi and f in by_importance]
        else:
            sel = getattr(self, f"_{self.method}")(data, sel, label)
        if len(sel) > self.n:
            sel = self._importance(data, sel, label)
        self.selected = sel
        return self

    def _variance(self, data, sel, label):
        kept = {r["feature"] for r in S.variance_filter(data, sel, self.variance).collect()}
        return [f for f in sel if f in kept]

    def _correlation(self, data, sel, label):
        kept = {r["feature"] for r in S.correlation_filter(data, sel, self.correlation).collect()}
        return [f for f in sel if f in kept]

    def _mutual_info(self, data, sel, label):
        y = label
        if self.task == "regression":
            lo, hi = data.agg(F.min(label), F.max(label)).first()
            width = (hi - lo) / self.bins if hi is not None and hi > lo else 1.0
            data, y = data.withColumn("__y", F.least(F.floor((F.col(label) - F.lit(lo)) / F.lit(width)),
                                                     F.lit(self.bins - 1))), "__y"
        if self.task == "classification" and self.estimator == "neighbours":
            scores = mutual_info_neighbours(data, sel, y)
        else:
            scores = S.mutual_info(data, sel, y, self.bins)
        kept = {r["feature"] for r in S.top_by(scores, "mi", self.n).collect()}
        return [f for f in sel if f in kept]

    def _importance(self, data, sel, label):
        vec = T.vectors(data, sel, [label])
        kept = {f for f, _ in T.top_features(vec, sel, sel, label, self.n, self.rounds, self.task)}
        return [f for f in sel if f in kept]

    def _rfe(self, data, sel, label):
        return T.rfe_list(T.vectors(data, sel, [label]), sel, sel, label, self.n, task=self.task)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` and the selected columns."""
        if self.selected is None:
            raise ValueError("FeatureSelector is not fitted")
        return df.select(*keep, *self.selected)

    def table(self, spark) -> DataFrame:
        """(feature, position) of the stored selection."""
        if self.selected is None:
            raise ValueError("FeatureSelector is not fitted")
        return spark.createDataFrame([(f, i) for i, f in enumerate(self.selected)], "feature string, position int")
