"""Sources and sinks."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001, rows
from panelforge.sources import io
from panelforge.sources.bars import BENCHMARKS, benchmark_series


def test_vendor_csv_roundtrip(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("PANELFORGE_SCRATCH"))
    src = spark.createDataFrame(
        [("2020-01-02", "AAA", 1.0, 2.0, 0.5, 1.5, 1.4, 100.0, 0.0, 0.0),
         ("2020-01-03", "^IDX", 10.0, 11.0, 9.0, 10.5, None, 0.0, None, None)],
        "Date string, Ticker string, Open double, High double, Low double, Close double, "
        "`Adj Close` double, Volume double, Dividends double, `Stock Splits` double")
    io.write_stage(src, f"{d}/raw", fmt="csv")
    bars = io.load_bars(spark, f"{d}/raw", fmt="csv")
    assert dict(bars.dtypes)["date"] == "date" and dict(bars.dtypes)["adj_close"] == "double"
    r = bars.orderBy("date").collect()
    assert r[0]["date"] == dt.date(2020, 1, 2) and r[1]["adj_close"] is None


def test_wide_long_roundtrip(spark):
    tickers = list(BENCHMARKS.values())
    long = benchmark_series(spark, SF001)
    wide = io.to_wide(long, tickers, ["close"])
    back = io.wide_to_long(wide, tickers, ["close"])
    assert rows(back.select("ticker", "date", "close")) == rows(long.select("ticker", "date", "close"))


def test_read_or_build_reuses(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("PANELFORGE_SCRATCH"))
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("x", F.col("id") * 2)

    a = io.read_or_build(spark, f"{d}/stage", build)
    b = io.read_or_build(spark, f"{d}/stage", build)
    assert a.count() == b.count() == 5 and len(calls) == 1


def test_read_or_build_looks_at_parameters_and_completeness(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("PANELFORGE_SCRATCH"))
    made = []

    def build(n):
        return lambda: made.append(n) or spark.range(n)

    assert io.read_or_build(spark, f"{d}/s", build(3), params={"cut": "a"}).count() == 3
    assert io.read_or_build(spark, f"{d}/s", build(4), params={"cut": "b"}).count() == 4
    assert io.read_or_build(spark, f"{d}/s", build(5), params={"cut": "a"}).count() == 3
    os.remove(io.stage_path(f"{d}/s", {"cut": "a"}) + "/_SUCCESS")
    assert io.read_or_build(spark, f"{d}/s", build(6), params={"cut": "a"}).count() == 6
    assert made == [3, 4, 6]


def test_scaler_apply_twice_stays_readable(spark):
    import __spark_entry__ as E
    q = E.queries()["scaler_apply"]
    a, b = q(spark, SF001), q(spark, SF001)
    assert a.count() == b.count() > 0


def test_checkpoint_folder_must_be_set_on_a_cluster():
    import pytest
    from panelforge.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_profile(spark):
    long = benchmark_series(spark, SF001)
    r = io.panel_profile(long).first()
    assert r["n_tickers"] == 3 and r["n_rows"] == long.count()
