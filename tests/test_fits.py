"""The fit queue, published versions and the selector's intersection."""
import random
import threading

import pytest

from panelforge.operators import train as T
from panelforge.operators.fits import Fit, run_fits, workers
from panelforge.operators.selector import FeatureSelector
from panelforge.sources.io import publish, published


def fit(spark, log, name, after=(), fail=False, weight=1.0):
    def run(*inputs):
        log.append(name)
        if fail:
            raise RuntimeError(name)
        return [name, *[x for i in inputs for x in i]]

    return Fit(name, run, lambda out, path: T.save_list(spark, out, path + "/list"),
               lambda path: T.load_list(spark, path + "/list"), {"v": 1}, tuple(after), weight)


def test_order_and_resume(spark, tmp_path):
    log = []
    fits = [fit(spark, log, "c", ["a", "b"]), fit(spark, log, "a", weight=5), fit(spark, log, "b")]
    got = run_fits(spark, fits, f"file://{tmp_path}/one", 2)
    assert got == {"a": ["a"], "b": ["b"], "c": ["c", "a", "b"]} and log[-1] == "c"
    again = run_fits(spark, fits, f"file://{tmp_path}/one", 2)
    assert again == got and len(log) == 3                      # all loaded
    with pytest.raises(ValueError):
        run_fits(spark, [fit(spark, log, "x", ["y"]), fit(spark, log, "y", ["x"])], f"file://{tmp_path}/two", 2)
    with pytest.raises(ValueError):
        run_fits(spark, [fit(spark, log, "x", ["z"])], f"file://{tmp_path}/two", 2)


def test_an_error_keeps_what_ended(spark, tmp_path):
    log = []
    with pytest.raises(RuntimeError):
        run_fits(spark, [fit(spark, log, "a", weight=9), fit(spark, log, "bad", fail=True), fit(spark, log, "late", ["bad"])],
                 f"file://{tmp_path}/f", 1)
    assert log == ["a", "bad"]
    run_fits(spark, [fit(spark, log, "a"), fit(spark, log, "bad"), fit(spark, log, "late", ["bad"])], f"file://{tmp_path}/f", 1)
    assert log == ["a", "bad", "bad", "late"]


def test_fits_run_side_by_side(spark, tmp_path):
    both = threading.Barrier(2, timeout=60)

    def meet():
        both.wait()
        return ["met"]

    fits = [Fit(n, meet, lambda out, path: T.save_list(spark, out, path + "/list"), lambda path: None, {}) for n in "ab"]
    assert run_fits(spark, fits, f"file://{tmp_path}/s", 2) == {"a": ["met"], "b": ["met"]}
    assert workers(spark, 10_000, 50) == 1 and workers(spark, 1, 3) == 3
    assert T.vector_tasks(10, 8) == 1 and T.vector_tasks(100_000, 8) == 5
    assert T.vector_tasks(10**7, 8) == 8 and T.vector_tasks(10**6, 8, 6) == 1 and T.vector_tasks(10**6, 64, 6) == 10 and T.vector_tasks(10**9, 8) == 500


def panel(spark, n=1500):
    r = random.Random(7)
    rows = []
    for _ in range(n):
        y = r.randrange(2)
        a = r.gauss(0, 1) + 1.2 * y
        u = r.uniform(-1, 1)
        rows.append((y, a, a * 1.0001, r.gauss(0, 1), abs(u) if y else u * 0.2, 0.001 * r.random(), r.gauss(0, 1) + 0.3 * y))
    return spark.createDataFrame(rows, "y int, a double, a2 double, noise double, fold double, flat double, weak double")


FEATURES = ["a", "a2", "noise", "fold", "flat", "weak"]


def test_all_intersects_two_lists_of_one_set(spark, monkeypatch):
    d = panel(spark)
    seen = {}
    real_mi, real_imp = FeatureSelector._mutual_info, FeatureSelector._importance
    monkeypatch.setattr(FeatureSelector, "_mutual_info", lambda self, data, sel, label: seen.setdefault(
        "mi", (list(sel), ["a", "noise"]))[1])
    monkeypatch.setattr(FeatureSelector, "_importance", lambda self, data, sel, label: seen.setdefault(
        "imp", (list(sel), ["fold", "a"]))[1])
    s = FeatureSelector("all", 2).fit(d, FEATURES, "y")
    assert s.selected == ["a"]                                   # the lists disagree
    assert seen["mi"][0] == seen["imp"][0] == ["a", "noise", "fold", "weak"]
    monkeypatch.setattr(FeatureSelector, "_mutual_info", real_mi)
    monkeypatch.setattr(FeatureSelector, "_importance", real_imp)
    both = FeatureSelector("all", 2, rounds=10).fit(d, FEATURES, "y").selected
    by_mi = FeatureSelector("mutual_info", 2).fit(d, ["a", "noise", "fold", "weak"], "y").selected
    by_importance = FeatureSelector("importance", 2, rounds=10).fit(d, ["a", "noise", "fold", "weak"], "y").selected
    assert set(both) == set(by_mi) & set(by_importance)


def test_every_method_is_cut_to_n(spark):
    assert len(FeatureSelector("variance", 2, rounds=5).fit(panel(spark), FEATURES, "y").selected) == 2
    assert FeatureSelector("variance", 6).fit(panel(spark), FEATURES, "y").selected == ["a", "a2", "noise", "fold", "weak"]


def test_versions_are_published_whole(spark, tmp_path):
    path = f"file://{tmp_path}/models"
    assert published(spark, path) is None
    d = panel(spark, 300)
    one = {"t": (["a", "weak"], {"lr": T.fit_model(d, ["a", "weak"], "y", "lr")})}
    first = T.save_models(one, path, spark)
    assert published(spark, path).endswith(first.rsplit("/", 1)[-1])

    class Broken:
        def write(self):
            raise OSError("disk")

    with pytest.raises(OSError):                                 # an interrupted save
        T.save_models({"t": (["a"], {"lr": Broken()})}, path, spark)
    assert T.load_models(path, spark)["t"][0] == ["a", "weak"]   # the old version is whole
    T.save_models({"t": (["noise"], {"lr": T.fit_model(d, ["noise"], "y", "lr")})}, path, spark)
    assert T.load_models(path, spark)["t"][0] == ["noise"]
    publish(spark, path, first)
    assert T.load_models(path, spark)["t"][0] == ["a", "weak"]
