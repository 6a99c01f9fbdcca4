"""The engineered panel as a stage that grows by dates.

The stage holds one Parquet folder per year and the period table (rows and
MACD summaries per ticker and year), and a manifest that names both. An append
reads bars from the date ``since`` on and no more of the past than the new
values need:

* period summaries of earlier years come from the stored table, so EMA state
  reaches back over the whole history without reading it;
* rolling features need at most ``BACK`` rows before a row: the periods that
  hold them follow from the row counts in the table; the market's statistics of
  earlier dates are stored too, since they take the rows of all tickers;
* labels look ahead ``FWD`` rows, so the years whose last labels the new rows
  fill in are built again.

Years built again are written beside the old ones; the new manifest is
published last by one rename, so a reader sees the old or the new panel, and
an append that broke off leaves the old one. ``since`` may lie before the last
stored date: restated bars replace what was stored.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.operators.halo import BACK, FWD, period_table, with_period
from panelforge.plans.pipeline import carried, engineer_rows, market_table
from panelforge.sources.io import publish, published

PW = PanelWindow()


def _summaries(bars: DataFrame, pw: PanelWindow) -> DataFrame:
    return period_table(with_period(bars, pw), [a for s in carried() for a in s.aggs(pw.time)]).drop("__c0")


def _counted(t: DataFrame) -> DataFrame:
    """Rows before each period, of a table put together from two."""
    before = Window.partitionBy("__k").orderBy("__per").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("__c0", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _store(spark: SparkSession, out: str, panel: DataFrame, kept: dict[int, str], version: str, pw: PanelWindow) -> None:
    """Write the years of ``panel``, publish them with the ``kept`` ones."""
    fresh = f"{out}/{version}/years"
    panel.withColumn("__year", F.year(pw.time)).write.partitionBy("__year").parquet(fresh)
    years = [r[0] for r in spark.read.parquet(fresh).select("__year").distinct().collect()]
    files = {**kept, **{int(y): f"{version}/years/__year={y}" for y in years}}
    spark.createDataFrame(sorted(files.items()), "year int, path string").coalesce(1).write.parquet(f"{out}/{version}/manifest")
    publish(spark, out, f"{out}/{version}")


def build(spark: SparkSession, bars: DataFrame, out: str, pw: PanelWindow = PW) -> None:
    """Engineer the whole panel into a new stage under ``out``."""
    version = f"version-{uuid.uuid4().hex}"
    t = _counted(_stored(_summaries(bars, pw), f"{out}/{version}/periods"))
    stats = _stored(market_table(bars, t, pw), f"{out}/{version}/market")
    _store(spark, out, engineer_rows(bars, t, pw, stats=stats), {}, version, pw)


def read(spark: SparkSession, out: str, since: int | None = None) -> DataFrame:
    """The published panel, or its years from ``since`` on."""
    files = manifest(spark, out)
    paths = [f"{out}/{p}" for y, p in sorted(files.items()) if since is None or y >= since]
    return spark.read.parquet(*paths)


def manifest(spark: SparkSession, out: str) -> dict[int, str]:
    """year -> folder of the published version (one entry a year)."""
    version = published(spark, out)
    if version is None:
        raise ValueError(f"nothing is published under {out}")
    return {r["year"]: r["path"] for r in spark.read.parquet(f"{version}/manifest").collect()}


def append(spark: SparkSession, bars: DataFrame, out: str, since: dt.date, pw: PanelWindow = PW) -> int:
    """Bring the stage up to ``bars``, which differ from the stored ones only
    from ``since`` on. Returns the first year that was built again."""
    files, old = manifest(spark, out), published(spark, out)
    version = f"version-{uuid.uuid4().hex}"
    year = since.year
    late = _summaries(bars.where(F.col(pw.time) >= F.lit(dt.date(year, 1, 1))), pw)
    early = spark.read.parquet(f"{old}/periods").where(F.col("__per") < year)
    t = _counted(_stored(early.unionByName(late), f"{out}/{version}/periods"))

    # first year with a row whose label looks into the years that changed
    start = F.max(F.when(F.col("__per") >= year, 1)).over(Window.partitionBy("__k"))
    rows = F.sum(F.when(F.col("__per") < year, F.col("__n"))).over(Window.partitionBy("__k"))
    near = t.withColumn("__s", start).withColumn("__rows", rows).where(
        (F.col("__s") == 1) & (F.col("__per") < year) & (F.col("__rows") - F.col("__c0") - F.col("__n") < FWD))
    first = min(near.agg(F.min("__per")).first()[0] or year, year)

    # periods that those years reach back to, per ticker
    of = Window.partitionBy("__k")
    begin = F.min(F.when(F.col("__per") >= first, F.col("__c0"))).over(of)
    need = t.withColumn("__b", begin).where(
        F.col("__b").isNotNull() & ((F.col("__per") >= first) | (F.col("__b") - F.col("__c0") - F.col("__n") < BACK)))
    oldest = need.agg(F.min("__per")).first()[0]
    d = bars.where(F.col(pw.time) >= F.lit(dt.date(oldest, 1, 1)))
    keys = need.select(F.col("__k").alias("__nk"), F.col("__per").alias("__np"))
    d = with_period(d, pw).join(keys, (F.col("__k") == F.col("__nk")) & (F.col("__per") == F.col("__np")), "left_semi")
    d = d.drop("__k", "__per")
    later = F.year(pw.time) >= first
    stats = _stored(spark.read.parquet(f"{old}/market").where(~later)
                    .unionByName(market_table(d, t, pw).where(later)), f"{out}/{version}/market")
    _store(spark, out, engineer_rows(d, t, pw, stats=stats, since=first),
           {y: p for y, p in files.items() if y < first}, version, pw)
    return first
