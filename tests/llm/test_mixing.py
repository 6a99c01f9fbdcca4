import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from panelforge.llm.mixing import mix, offsets, water_fill
from tests.llm.conftest import ROWS


def levels(sizes, weights, most):
    """Reshare the excess until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, "d": 0, None: 400},
    {"a": 1, "b": 1, "c": 1000},
    {"é": 7, "z": 7, "A": 700, "😀": 3},
    {"only": 12},
    {"a": 0, "b": 0},
])
def test_water_fill(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
    got = {r.src: r.target for r in water_fill(df).collect()}
    for s, t in levels(sizes, (5, 2, 1), 3).items():
        assert got[s] == pytest.approx(float(t))


def test_odd_rows(docs):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    words = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        words[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = levels(dict(words), (5, 2, 1), 3)
    taken = defaultdict(int)
    by_size = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
        by_size[r.source_size] = r.target
    assert set(by_size) == set(words.values())
    for s, n in words.items():
        assert by_size[n] == pytest.approx(float(want[s]))
        assert abs(taken[n] - by_size[n]) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs.repartition(2)).collect()), key=str)


def test_empty_table(none):
    assert mix(none).count() == 0


def test_hot_source_over_many_buckets(spark):
    d = spark.range(20_000).selectExpr(
        "id as doc_id", "repeat('w ', cast(id % 17 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    rows = mix(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source", "target").sum("taken").collect()
    assert len(rows) == 8
    assert all(abs(r["sum(taken)"] - r.target) <= 1 for r in rows)


def test_offsets_in_two_levels(spark):
    r = random.Random(5)
    for digits in (1, 2, 3):
        rows = [(src, f"{b:0{digits}x}", r.randint(0, 9)) for src in ("a", "b", None)
                for b in sorted(r.sample(range(16 ** digits), min(16 ** digits, 60)))]
        want, sums = set(), {}
        for src, b, n in rows:
            want.add((src, b, n, sums.get(src, 0)))
            sums[src] = sums.get(src, 0) + n
        got = offsets(spark.createDataFrame(rows, "src string, b string, bs long"), digits).collect()
        assert len(got) == len(rows) and {tuple(x) for x in got} == want
