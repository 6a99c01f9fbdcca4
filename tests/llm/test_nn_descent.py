import math

import numpy as np
import pytest

from panelforge.llm.nn_descent import best_pairs, near_vectors, tables_needed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64), g) for i, v, g in rows
            if v is not None and g is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n = len(good)
    link = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(a):
            (_, x, g), (_, y, h) = good[a], good[b]
            if g == h and len(x) == len(y):
                link[a, b] = link[b, a] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
    comp = np.arange(n)
    for _ in range(n):
        new = np.array([min([comp[a], *comp[link[a]]]) for a in range(n)])
        if (new == comp).all():
            break
        comp = new
    low = {}
    for (i, _, _), c in zip(good, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    out = [(i, int(link[a].sum()), low.get(comp[a])) for a, (i, _, _) in enumerate(good)]
    names = [id(v) for _, v, _ in rows]
    bad = [i for i, v, g in rows if v is None or g is None or not len(v)
           or not all(x is not None and math.isfinite(x) for x in v) or not any(v)]
    assert names
    return out + [(i, 0, i) for i in bad]


def clusters(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = rng.standard_normal(dim)
        g = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 1, 2, 3, 40]))):
            noise = rng.choice([0.0, 0.02, 0.05])
            v = c / np.linalg.norm(c) + noise * rng.standard_normal(dim) / 1.5
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], g))
    return rows[:n]


def check(spark, rows, **kw):
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in
                  near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), **kw).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_clusters_against_all_pairs(spark):
    check(spark, clusters(500))


def test_one_cluster_larger_than_any_list(spark):
    rng = np.random.default_rng(1)
    c = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in c + 0.05 * rng.standard_normal(16)], 1) for i in range(700)]
    check(spark, rows)


def test_odd_rows(spark):
    v = [0.5, 0.25, 1.0]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, [2 * x for x in v], 1), (3, v, None), (4, None, 1), (5, [], 1),
            (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [float("inf"), 1.0, 0.0], 1),
            (9, [None, 1.0, 0.0], 1), (10, v, 2), (11, v[:2], 1), (None, v, 2), (12, [-x for x in v], 1)]
    check(spark, rows)
    d = spark.createDataFrame(rows, SCHEMA + "")
    assert near_vectors(d.limit(0)).count() == 0
    from pyspark.sql import functions as F
    for c in ("node", "n", "block", "v", "ok", "kept"):
        d = d.withColumn(c, F.lit("x"))
    assert near_vectors(d).count() == len(rows)


def test_lists_get_only_better_and_new_neighbours():
    x = np.array([[1.0, 0], [0.99, 0.141067], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    (a, b, _, fresh), (p, q) = best_pairs(np.array([5, 6, 7]), x, 2, 0.98, np.array([-2.0, 0.5, 0.5]),
                                   [np.array([7]), np.array([]), np.array([])])
    assert set(zip(a.tolist(), b.tolist())) == {(5, 6), (6, 5)}
    assert list(zip(p.tolist(), q.tolist())) == [(5, 6)] and fresh.all()


def test_tables_grow_with_the_block():
    assert tables_needed(10) == tables_needed(64) < tables_needed(10**6) < tables_needed(10**9) < 100
    assert tables_needed(0) >= 4


def two_dense(links, dim=64, size=500, seed=5):
    """Two clusters of ``size`` whose members all link within, and ``links``
    pairs across: a vector of the second cluster moved to just within reach of
    one of the first."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.standard_normal((dim, 3)))[0].T
    theta = math.acos(0.98)
    c1, c2 = axes[0], math.cos(2.2 * theta) * axes[0] + math.sin(2.2 * theta) * axes[1]
    rows = []
    for c in (c1, c2):
        for _ in range(size - links):
            v = c + 0.012 * rng.standard_normal(dim)
            rows.append(v / np.linalg.norm(v))
    for i in range(links):          # bridge ends, 0.9 of the threshold's angle apart
        w = 0.004 * rng.standard_normal(dim)
        for t in (0.65, 1.55):
            rows.append(math.cos(t * theta) * axes[0] + math.sin(t * theta) * axes[1] + w)
    return [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)]


@pytest.mark.parametrize("links", [1, 26])
def test_dense_clusters_joined_by_few_links(spark, links):
    rows = two_dense(links)
    assert len({c for _, _, c in brute(rows)}) == 1
    check(spark, rows, chunk=128)


def test_exact_search_without_any_descent(spark, monkeypatch):
    """Links that no list found are all found between chunks."""
    import panelforge.llm.nn_descent as nn
    real = nn.descend
    monkeypatch.setattr(nn, "descend", lambda *a: real(*a).limit(3))
    check(spark, clusters(300, seed=8), chunk=64)


def test_doubles_keep_their_digits(spark):
    big = 1e300
    rows = [(0, [big, big], 1), (1, [big, big * (1 + 1e-9)], 1), (2, [big, -big], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(d).collect()) == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]
