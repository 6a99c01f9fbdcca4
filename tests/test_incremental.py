"""Appending dates to the engineered stage against building it anew."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import assert_frames_close
from panelforge.plans import incremental as I
from panelforge.plans.pipeline import engineer_features


def bars(spark, n=900):
    r = random.Random(3)
    rows = []
    for t, every, start in (("daily", 1, 0), ("thin", 9, 0), ("gone", 1, 0), ("new", 1, 700)):
        px = 50.0
        for i in range(start, n):
            px *= 1 + r.gauss(0, 0.02)
            if i % every or (t == "gone" and i > 400) or r.random() < 0.05:
                continue
            o = px * (1 + r.gauss(0, 0.005))
            close = None if r.random() < 0.03 else px
            rows.append((t, dt.date(2019, 3, 1) + dt.timedelta(days=i), o, max(o, px) * 1.01, min(o, px) * 0.99, close,
                         float(r.randrange(100, 900)), close))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, "
                                       "volume double, adj_close double").repartition(4).cache()


def test_appended_days_equal_a_full_build(spark, tmp_path):
    """One day, then later days together with a restated bar of the past."""
    all_bars, out = bars(spark), f"file://{tmp_path}/panel"
    last = dt.date(2019, 3, 1) + dt.timedelta(days=899)
    cut = last - dt.timedelta(days=40)
    past = cut - dt.timedelta(days=5)
    restated = all_bars.withColumn("adj_close", F.when(F.col("date") == past, F.col("adj_close") * 1.5)
                                   .otherwise(F.col("adj_close"))).cache()
    I.build(spark, all_bars.where(F.col("date") < cut), out)
    for now, since in ((all_bars.where(F.col("date") <= cut), cut), (restated, past)):
        first = I.append(spark, now, out, since)
        assert min(I.manifest(spark, out)) == 2019 <= first
        want, got = engineer_features(now), I.read(spark, out)
        assert got.columns == want.columns
        assert_frames_close(got, want, rtol=1e-10, atol=1e-11)


def test_a_broken_append_leaves_the_old_panel(spark, tmp_path, monkeypatch):
    old, out = bars(spark, 450), f"file://{tmp_path}/panel"
    day = dt.date(2019, 3, 1) + dt.timedelta(days=420)
    monkeypatch.setattr(I, "engineer_rows", lambda d, *a, since=None, **k: d.where(F.year("date") >= (since or 0)))
    monkeypatch.setattr(I, "market_table", lambda d, *a: d.groupBy("date").agg(F.count("close").alias("n")))
    I.build(spark, old.where(F.col("date") < day), out)
    rows = I.read(spark, out).count()
    with monkeypatch.context() as m:
        m.setattr(I, "publish", lambda *a: (_ for _ in ()).throw(OSError("store")))
        with pytest.raises(OSError):
            I.append(spark, old, out, day)
    assert I.read(spark, out).count() == rows
    I.append(spark, old, out, day)
    assert I.read(spark, out).count() == old.count() > rows
