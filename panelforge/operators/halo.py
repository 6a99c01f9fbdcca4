"""Per-ticker windows without one task per ticker.

``partitionBy(ticker)`` puts a whole series in one task, so a ticker holding a
third of all rows becomes a third of the work in one task. Instead a series is
cut into periods and buckets of PERIODS periods:

* With a DATE column a period is a calendar year: at most 366 rows, since a
  ticker has one row a date. No row needs its position in the series.
* With any other time column a period is 366 rows by position (``positions``).

Every rolling feature and every label reaches a fixed number of rows back or
ahead (at most 252), so a bucket also receives copies of the whole periods
that those rows can lie in. Which ones they are follows from the number of
rows in each period, a table of tickers x periods (``period_table``), which is
joined to the panel before its one exchange on (ticker, bucket). All windows
of a frame share the order (period, time) inside (ticker, bucket), so they
share one sort. Copies are dropped at the end.

Features without a fixed reach (forward fills, EMA) put what a period receives
from the ones before it into the same table: see ``carry``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from panelforge.functions.frames import PanelWindow
from panelforge.sources.io import stage

PW = PanelWindow()
BACK = 256     # rows that a rolling feature may look back
FWD = 252      # rows that a label may look ahead
PERIOD = 366   # rows of a period at most
# Rows of a bucket (8 periods): with its copies, about what the window
# operator's default in-memory row buffer holds (4,096 rows).
BUCKET = 2928
HELPERS = ("__k", "__per", "__bucket", "__halo")


def positions(df: DataFrame, pw: PanelWindow = PW, grain: str = "year") -> DataFrame:
    """Add ``__gpos``: 0-based row position of each row within its ticker.

    Rows are numbered inside their (ticker, grain) first; the offset of a grain
    is the rows before it, from a table of tickers x grains. Its join has plain
    keys, the ones the rows are dealt by already."""
    if "__gpos" in df.columns:
        return df
    old = F.to_timestamp(F.lit("0001-01-01"))
    d = df.select("*", F.coalesce(F.col(pw.key).cast("string"), F.lit("\0")).alias("__nk"),
                  F.coalesce(F.date_trunc(grain, F.col(pw.time)), old).alias("__grain"))
    counts = d.groupBy("__nk", "__grain").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select("__nk", "__grain", F.coalesce(F.sum("__n").over(
        Window.partitionBy("__nk").orderBy("__grain").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__off"))
    rn = F.row_number().over(Window.partitionBy("__nk", "__grain").orderBy(pw.time)) - 1
    d = d.withColumn("__rn", rn).join(counts, ["__nk", "__grain"])
    return d.select(*df.columns, (F.col("__off") + F.col("__rn")).alias("__gpos"))


def with_period(df: DataFrame, pw: PanelWindow = PW) -> DataFrame:
    """Add ``__k`` (the ticker, never null) and the period ``__per``."""
    if "__per" in df.columns:
        return df
    if isinstance(df.schema[pw.time].dataType, DateType):
        d, per = df, F.coalesce(F.year(pw.time), F.lit(0))
    else:
        d, per = positions(df, pw), F.floor(F.col("__gpos") / PERIOD).cast("int")
    d = d.select("*", F.coalesce(F.col(pw.key).cast("string"), F.lit("\0")).alias("__k"), per.alias("__per"))
    return d.drop("__gpos") if "__gpos" not in df.columns else d


def period_table(df: DataFrame, aggs: Sequence = ()) -> DataFrame:
    """One row per (__k, __per): rows ``__n``, rows before it ``__c0``, and
    ``aggs``. Partial aggregates are combined before the shuffle."""
    t = df.groupBy("__k", "__per").agg(F.count(F.lit(1)).alias("__n"), *aggs)
    before = Window.partitionBy("__k").orderBy("__per").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("*", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__c0"))


def reached(t: DataFrame, back: int, fwd: int, size: int) -> DataFrame:
    """Adds the buckets that receive a period: its own, and those whose first
    (last) row lies within ``back`` (``fwd``) rows of its last (first) one. A
    period holds at most PERIOD rows, which bounds the range frames."""
    own = F.floor(F.col("__per") / size).cast("int")
    w = Window.partitionBy("__k").orderBy("__c0")
    hi = F.max(own).over(w.rangeBetween(0, back + PERIOD)) if back else own
    lo = F.min(own).over(w.rangeBetween(-(fwd + PERIOD), 0)) if fwd else own
    return t.select("*", lo.alias("__lo"), hi.alias("__hi"))


SMALL = 32 << 20   # bytes of a period table that is broadcast


def periods_of(df: DataFrame, pw: PanelWindow = PW, states: Sequence = ()) -> DataFrame:
    """The stored period table of a panel with the summaries of ``states``."""
    return stage(period_table(with_period(df, pw), [a for s in states for a in s.aggs(pw.time)]), "periods")


def longest_series(t: DataFrame) -> int:
    """Periods of the series that has most of them."""
    return t.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def with_halo(df: DataFrame, fn: Callable[[DataFrame, PanelWindow], DataFrame] | None = None,
              pw: PanelWindow = PW, back: int = BACK, fwd: int = 0, bucket: int = BUCKET,
              states: Sequence = (), periods: DataFrame | None = None) -> DataFrame:
    """Run ``fn(frame, window)`` on halo buckets and return its rows once.

    ``back`` / ``fwd`` are the rows that ``fn`` reaches back / ahead, ``bucket``
    about the rows of a bucket. ``states`` (``carry.Fill``, ``carry.Ema``,
    ``carry.Macd``) add their columns to the frame before ``fn`` runs.
    ``periods`` is the period table when the caller has it already."""
    size = max(1, bucket // PERIOD)
    d = with_period(df, pw)
    t = periods_of(d, pw, states) if periods is None else periods
    entry = [c for s in states for c in s.entry()]
    small = t.count() * (64 + 16 * len(entry)) <= SMALL
    t = reached(t, back, fwd, size)
    for s in states:
        t = s.scan(t)
    t = t.select("__k", "__per", "__lo", "__hi", *entry)
    d = d.join(F.broadcast(t) if small else t, ["__k", "__per"])
    d = d.select("*", F.explode(F.sequence("__lo", "__hi")).alias("__bucket"))
    d = d.withColumn("__halo", F.col("__bucket") != F.floor(F.col("__per") / size)).drop("__lo", "__hi")
    hw = PanelWindow(key=pw.key, time=pw.time, extra=(*pw.extra, "__bucket"), lead_by=("__per",))
    for s in states:
        d = s.rows(d, hw)
    if fn is not None:
        d = fn(d, hw)
    return d.filter(~F.col("__halo")).drop(*HELPERS)
