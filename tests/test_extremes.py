"""Rolling extremes by block scans against plain frames."""
import datetime as dt
import random

import pytest

from panelforge.operators.halo import with_halo
from panelforge.operators.windows import dist_extremes, rolling_extremes

SPANS = [("one", 1), ("two", 2), ("week", 5), ("year", 252), ("long", 400)]


def panel(spark, sizes):
    r = random.Random(3)
    rows, series = [], {}
    for t, n in sizes.items():
        v = [None if r.random() < 0.01 else r.choice([0.0, -1.5, r.uniform(-9, 9)]) for _ in range(n)]
        series[t] = v
        rows += [(t, dt.date(1999, 6, 1) + dt.timedelta(days=i), x) for i, x in enumerate(v)]
    r.shuffle(rows)
    return series, spark.createDataFrame(rows, "ticker string, date date, close double")


def want(v, i, n):
    f = v[max(0, i - n + 1):i + 1]
    return (max(f), min(f)) if len(f) == n and None not in f else (None, None)


def check(series, df, spans):
    got = {}
    for r in df.orderBy("ticker", "date").collect():
        got.setdefault(r.ticker, []).append(r)
    assert {t: len(v) for t, v in got.items()} == {t: len(v) for t, v in series.items() if v}
    for t, rows in got.items():
        for i, r in enumerate(rows):
            for label, n in spans:
                assert (r[f"__max_{label}"], r[f"__min_{label}"]) == want(series[t], i, n), (t, i, label)


def test_extremes_equal_frames(spark):
    series, d = panel(spark, {"A": 1300, "B": 252, "C": 251, "D": 1, "E": 504})
    check(series, rolling_extremes(d, spans=SPANS), SPANS)


def test_extremes_equal_frames_in_buckets(spark):
    series, d = panel(spark, {"A": 2500, "B": 40})
    spans = SPANS[:4]
    got = with_halo(d, lambda f, w: rolling_extremes(f, w, spans=spans), back=252, bucket=366)
    check(series, got, spans)


def test_plan_has_no_frame_of_the_span(spark):
    _, d = panel(spark, {"A": 300})
    plan = dist_extremes(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "-251" not in plan and "-20," not in plan and "unboundedpreceding$()" in plan


@pytest.mark.parametrize("n", [0, 3])
def test_short_and_empty_series(spark, n):
    series, d = panel(spark, {"A": n})
    check(series, rolling_extremes(d, spans=SPANS), SPANS)
