"""Models are written and read side by side, whole or not at all."""
import threading

import pytest

from panelforge.operators import train as T
from panelforge.operators.fits import run_each
from panelforge.sources.io import published


class Meets:
    """A model whose save ends when another one is being saved as well."""

    def __init__(self, both):
        self.both = both

    def write(self):
        return self

    def save(self, path):
        self.both.wait()


def test_models_are_saved_side_by_side(spark, tmp_path):
    both = threading.Barrier(2, timeout=30)
    path = f"file://{tmp_path}/models"
    version = T.save_models({"t": (["a"], {"rf": Meets(both), "lr": Meets(both)})}, path, spark)
    assert published(spark, path).endswith(version.rsplit("/", 1)[-1])


def test_models_are_loaded_side_by_side(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/models"
    both, free = threading.Barrier(2, timeout=30), threading.Barrier(1)
    T.save_models({"s": (["a", "b"], {"lr": Meets(free)}), "t": (["b"], {"lr": Meets(free)})}, path, spark)

    def load(at):
        both.wait()
        return at.rsplit("/", 1)[-1]

    monkeypatch.setattr(T.PipelineModel, "load", staticmethod(load))
    assert T.load_models(path, spark) == {"s": (["a", "b"], {"lr": "s_lr"}), "t": (["b"], {"lr": "t_lr"})}


def test_outcomes_keep_their_order_and_errors_are_raised(spark):
    assert run_each(spark, lambda a, b: a - b, [(i, 1) for i in range(40)]) == list(range(-1, 39))
    assert run_each(spark, lambda: 1, []) == []
    with pytest.raises(ZeroDivisionError):
        run_each(spark, lambda a: 1 // a, [(1,), (0,), (2,)])
