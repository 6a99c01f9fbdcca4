"""Bucketed windows and carried state against plain loops over whole series."""
import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01, rows
from panelforge.operators import windows as W
from panelforge.operators.carry import ema, forward_fill, macd
from panelforge.operators.halo import positions, with_halo
from panelforge.operators.labels import labels
from panelforge.sources.bars import stock_panel


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


def frame(spark, series, col="adj_close"):
    return spark.createDataFrame([(t, day(i), v) for t, xs in series.items() for i, v in enumerate(xs)],
                                 f"ticker string, date date, {col} double").repartition(4)


def ema_loop(xs, span):
    """y0 = x0; after g rows: (q**g * y + a * x) / (q**g + a); kept where x is missing."""
    a, y, gap, out = 2.0 / (span + 1), None, 0, []
    for x in xs:
        gap += 1
        if x is not None:
            p = (1 - a) ** gap
            y = x if y is None else (p * y + a * x) / (p + a)
            gap = 0
        out.append(y)
    return out


def with_nulls(n, seed, runs):
    r = random.Random(seed)
    xs, x = [], 100.0
    for _ in range(n):
        x *= math.exp(r.gauss(0, 0.02))
        xs.append(x)
    for a, b in runs:
        xs[a:b] = [None] * (b - a)
    return xs


SERIES = {
    "dense": with_nulls(1700, 1, []),
    "long_run": with_nulls(3000, 2, [(0, 5), (100, 2200), (2300, 2301)]),     # longer than three buckets
    "sparse": [x if i % 14 == 3 else None for i, x in enumerate(with_nulls(2500, 3, []))],
    "none": [None] * 900,
    "one": [None] * 750 + [5.0] + [None] * 800,
}


def column(df, ticker, name):
    return [r[name] for r in df.filter(F.col("ticker") == ticker).orderBy("date").collect()]


def same(a, b, rel=1e-8):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=rel, abs=1e-9))


def test_ema_and_macd_over_null_runs(spark):
    d = frame(spark, SERIES)
    e = ema(d, "adj_close", [12, 26], ["e12", "e26"], bucket=700).cache()
    m = macd(d, bucket=700).cache()
    assert e.columns == [*d.columns, "e12", "e26"]
    for t, xs in SERIES.items():
        fast, slow = ema_loop(xs, 12), ema_loop(xs, 26)
        same(column(e, t, "e12"), fast)
        same(column(e, t, "e26"), slow)
        line = [None if f is None else f - s for f, s in zip(fast, slow)]
        same(column(m, t, "macd_signal"), ema_loop(line, 9), rel=1e-6)


def test_forward_fill_over_null_runs(spark):
    got = forward_fill(frame(spark, SERIES), ["adj_close"], bucket=700).cache()
    for t, xs in SERIES.items():
        want, last = [], None
        for x in xs:
            last = x if x is not None else last
            want.append(last)
        assert column(got, t, "adj_close") == want


def test_positions_are_row_numbers(spark):
    p = stock_panel(spark, SF01)
    got = positions(p).select("ticker", "date", "__gpos")
    want = p.select("ticker", "date", (F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)
                    .alias("__gpos"))
    assert rows(got) == rows(want)


def test_hot_ticker_in_buckets(spark):
    """One ticker with most of the rows: frames and labels cross many buckets."""
    series = {"hot": with_nulls(2600, 5, [(900, 1300)]), "a": with_nulls(300, 6, []), "b": [1.0]}
    d = frame(spark, series)
    got = with_halo(d, lambda f, w: labels(W.dist_extremes(W.sma(W.returns_multi(f, w), w), w, "adj_close"), w),
                    back=256, fwd=252, bucket=300).cache()
    assert "__gpos" not in got.columns and got.count() == d.count()

    def ratio(a, b):
        return None if a is None or b is None else a / b - 1

    for t, xs in series.items():
        n = len(xs)
        same(column(got, t, "return_252d"), [ratio(xs[i], xs[i - 252]) if i >= 252 else None for i in range(n)])
        full = [xs[i - 199:i + 1] if i >= 199 else [None] for i in range(n)]
        same(column(got, t, "sma_200"), [None if None in f else sum(f) / 200 for f in full])
        high = [xs[i - 251:i + 1] if i >= 251 else [None] for i in range(n)]
        same(column(got, t, "dist_from_52w_high"), [None if None in f else f[-1] / max(f) - 1 for f in high])
        same(column(got, t, "target_return_12m"), [ratio(xs[i + 252], xs[i]) if i + 252 < n else None for i in range(n)])


def test_any_span_over_many_periods(spark):
    """55 years of days, most of them missing: state crosses many periods."""
    long = {"thin": [x if i % 50 == 7 else None for i, x in enumerate(with_nulls(20_000, 9, []))],
            "full": with_nulls(6_000, 10, [(1200, 4100)])}
    spans = [2, 9, 200, 1000, 5000]
    got = ema(frame(spark, long), "adj_close", [1, *spans], ["e1", *[f"e{s}" for s in spans]]).cache()
    for t, xs in long.items():
        for s in spans:
            same(column(got, t, f"e{s}"), ema_loop(xs, s), rel=1e-10)
        last, fill = None, []
        for x in xs:
            last = x if x is not None else last
            fill.append(last)
        assert column(got, t, "e1") == fill


def test_macd_over_many_periods(spark):
    xs = {"thin": [x if i % 50 == 7 else None for i, x in enumerate(with_nulls(9_000, 11, []))],
          "late": [None] * 800 + with_nulls(1_500, 12, [(300, 900)])}
    got = macd(frame(spark, xs)).cache()
    for t, x in xs.items():
        line = [None if a is None else a - b for a, b in zip(ema_loop(x, 12), ema_loop(x, 26))]
        signal = ema_loop(line, 9)
        same(column(got, t, "macd"), line, rel=1e-7)
        same(column(got, t, "macd_signal"), signal, rel=1e-7)
        same(column(got, t, "macd_hist"), [None if a is None else a - b for a, b in zip(line, signal)], rel=1e-6)


def test_timestamps_are_cut_by_position(spark):
    """Many rows a day: periods are 366 rows, not calendar years."""
    start = dt.datetime(2024, 1, 1)
    xs = with_nulls(2_400, 13, [(500, 1300)])
    d = spark.createDataFrame([("a", start + dt.timedelta(minutes=7 * i), x) for i, x in enumerate(xs)],
                              "ticker string, date timestamp, adj_close double").repartition(4)
    same(column(ema(d, "adj_close", [26], ["e"]), "a", "e"), ema_loop(xs, 26))
    got = with_halo(d, lambda f, w: W.sma(f, w), back=200, bucket=366)
    full = [xs[i - 199:i + 1] if i >= 199 else [None] for i in range(len(xs))]
    same(column(got, "a", "sma_200"), [None if None in f else sum(f) / 200 for f in full])


def test_sparse_tickers_reach_many_years(spark):
    """Three rows a year, and years without any: frames span decades."""
    days = [dt.date(y, m, 5) for y in range(1700, 2000) if y % 9 for m in (2, 6, 11)]
    xs = with_nulls(len(days), 14, [])
    rows_ = [("s", d, x) for d, x in zip(days, xs)] + [(None, d, x) for d, x in zip(days, xs)]
    d = spark.createDataFrame(rows_, "ticker string, date date, adj_close double").repartition(4)
    for bucket in (366, 2928):
        got = with_halo(d, lambda f, w: labels(W.sma(W.returns_multi(f, w), w), w), back=256, fwd=252, bucket=bucket).cache()
        assert got.count() == d.count()
        want = [xs[i] / xs[i - 252] - 1 if i >= 252 else None for i in range(len(xs))]
        same(column(got, "s", "return_252d"), want)
        same([r.return_252d for r in got.filter("ticker is null").orderBy("date").collect()], want)
        same(column(got, "s", "sma_200"), [sum(xs[i - 199:i + 1]) / 200 if i >= 199 else None for i in range(len(xs))])
        same(column(got, "s", "target_return_12m"), [xs[i + 252] / xs[i] - 1 if i + 252 < len(xs) else None
                                                     for i in range(len(xs))])


def test_short_spans_are_refused(spark):
    with pytest.raises(ValueError):
        ema(frame(spark, {"a": [1.0]}), "adj_close", [1.2], ["e"])
