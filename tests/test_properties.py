"""Properties of the time features: no look-ahead, per-ticker independence,
order invariance; and the ML stages."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import SF001
from helpers import assert_frames_close
from panelforge.operators import train as T
from panelforge.operators.features import panel_features
from panelforge.sources.bars import stock_panel

CUT = dt.date(1999, 1, 1)


def test_no_look_ahead(spark):
    p = stock_panel(spark, SF001).checkpoint()
    changed = p.withColumn("adj_close", F.when(F.col("date") >= CUT, F.col("adj_close") * 3)
                           .otherwise(F.col("adj_close")))
    a = panel_features(p).filter(F.col("date") < CUT)
    b = panel_features(changed).filter(F.col("date") < CUT)
    assert_frames_close(a, b)


def test_ticker_independence_and_order(spark):
    p = stock_panel(spark, SF001).checkpoint()
    one = p.filter(F.col("ticker") == "Brand#11")
    a = panel_features(p).filter(F.col("ticker") == "Brand#11")
    b = panel_features(one.repartition(5).orderBy(F.rand(7)))
    assert_frames_close(a, b)


def test_fit_score_save_load(spark, tmp_path):
    p = stock_panel(spark, SF001)
    df = panel_features(p, labels="strict").filter(F.col("target_direction_5d").isNotNull())
    feats = ["return_1d", "return_5d", "rsi_14", "volatility_21d", "gap"]
    m = T.fit_model(df, feats, "target_direction_5d", "gbt", rounds=5)
    s = T.score(m, df, feats, ["ticker", "date"])
    assert s.filter((F.col("p") < 0) | (F.col("p") > 1)).count() == 0
    models = {"direction_5d": (feats, {"gbt": m})}
    path = str(tmp_path / "models")
    T.save_models(models, path, spark)
    s2 = T.score(T.load_model(path, "direction_5d", "gbt"), df, feats, ["ticker", "date"])
    d = s.join(s2.withColumnRenamed("p", "p2"), ["ticker", "date"]).agg(
        F.max(F.abs(F.col("p") - F.col("p2")))).first()[0]
    assert d == 0.0
