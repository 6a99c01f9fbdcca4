"""Train and test runs over stored stages."""
from conftest import SF001
from panelforge.plans.runs import run_test, run_train
from panelforge.sources.bars import stock_panel


def test_run_train_then_test(spark, tmp_path):
    out = str(tmp_path / "run")
    bars = stock_panel(spark, SF001)
    models = run_train(spark, bars, out, "1999-01-01", rounds=3, families=("gbt", "lr"),
                       select_rounds=3, min_rows=500)
    assert models
    res = run_test(spark, out, "1999-01-01", families=("gbt", "lr"))
    r = res.collect()
    assert {x["model"] for x in r} == {"gbt", "lr", "ensemble"}
    assert all(0 <= x["accuracy"] <= 1 and 0 <= x["auc"] <= 1 for x in r)


def test_another_cut_fits_another_scaler(spark, tmp_path):
    out = str(tmp_path / "run")
    bars = stock_panel(spark, SF001)
    for cut in ("1999-01-01", "1997-01-01"):
        run_train(spark, bars, out, cut, rounds=2, families=("lr",), select_rounds=1, min_rows=10**9, purged=True)
    fitted = sorted(p.name for p in (tmp_path / "run").iterdir() if p.name.startswith("scaler-"))
    assert len(fitted) == 2
    a, b = (spark.read.parquet(f"{out}/{f}").agg({"n_train": "sum"}).first()[0] for f in fitted)
    assert a != b
    assert len([p for p in (tmp_path / "run").iterdir() if p.name.startswith("engineered-")]) == 1
