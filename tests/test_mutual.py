"""Nearest-neighbour mutual information against a brute-force count."""
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators.mutual import digamma, mutual_info_neighbours


def psi(n):
    return sum(1.0 / i for i in range(1, n)) - 0.5772156649015329


def brute(rows, k=3):
    """rows: (x, y). Every row against every other one."""
    rows = [(x if x is not None else 0.0, y) for x, y in rows if y is not None]
    size = {}
    for _, y in rows:
        size[y] = size.get(y, 0) + 1
    rows = [(x, y) for x, y in rows if size[y] > 1]
    n, total = len(rows), 0.0
    for i, (x, y) in enumerate(rows):
        own = sorted(abs(x - v) for j, (v, c) in enumerate(rows) if c == y and j != i)
        r = own[min(k, size[y] - 1) - 1]
        if r == 0:
            ki = sum(1 for v, c in rows if c == y and v == x)
            m = sum(1 for v, _ in rows if v == x)
        else:
            ki = 1 + sum(1 for d in own if d < r)
            m = sum(1 for v, _ in rows if x - r < v < x + r)
        total += psi(ki) - psi(size[y]) - psi(m)
    return max(0.0, psi(n) + total / n)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        y = r.choice([0, 0, 0, 1, 1, 2]) if i else 3            # class 3 has one row
        rows.append((None if r.random() < 0.05 else y, r.gauss(0, 1) + 2 * y, r.gauss(0, 1), float(r.randrange(4) + (y == 1)),
                     0.0 if r.random() < 0.8 else r.gauss(y, 1), None if r.random() < 0.3 else float(y), 7.0))
    cols = ["close", "noise", "steps", "zeros", "holes", "flat"]
    d = spark.createDataFrame(rows, "y int, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    want = {c: brute([(row[1 + j], row[0]) for row in rows]) for j, c in enumerate(cols)}
    assert want["close"] > 0.3 and want["flat"] == pytest.approx(0, abs=1e-9)
    for parts in (None, 40):          # 40: many parts hold fewer rows of a class than neighbours
        got = {g.feature: g.mi for g in mutual_info_neighbours(d, cols, "y", parts=parts).collect()}
        assert set(got) == set(cols)
        for c in cols:
            assert got[c] == pytest.approx(want[c], abs=1e-9), c


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 200).select("id", digamma(F.col("id")).alias("p"))
           .orderBy("id").collect()]
    assert all(math.isclose(g, psi(i), abs_tol=1e-12) for i, g in enumerate(got, 1))


def test_tiny_classes(spark):
    rows = [(0, 1.0), (0, 2.0), (1, 1.5), (1, 9.0), (1, 9.5)]
    d = spark.createDataFrame(rows, "y int, x double")
    assert mutual_info_neighbours(d, ["x"], "y").first().mi == pytest.approx(brute([(x, y) for y, x in rows]), abs=1e-9)
