import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import common
from panelforge.llm.minhash import minima, matrix, near_components, near_dedup, packed, shingles, similarity
from tests.llm.conftest import ROWS


def exact(rows, percent=85):
    """Components by comparing all pairs of shingle sets."""
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return [(i, len(s), low.get(find(x))) for x, (i, s) in enumerate(sets)]


def near_copies(n, groups, seed=0, length=60):
    r = random.Random(seed)
    base = [[f"w{r.randrange(5000)}" for _ in range(length)] for _ in range(groups)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    return rows


def compare(spark, rows, **kw):
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = sorted((r.id, r.n, r.component_id) for r in near_components(d, **kw).collect())
    assert got == sorted(exact(rows))


def test_near_copies_against_all_pairs(spark):
    compare(spark, near_copies(400, 25))


def test_one_large_group_in_small_cells(spark):
    compare(spark, near_copies(300, 1, seed=3), bucket_chunk=32, set_chunk=16)


def test_components_over_many_chunks(spark, monkeypatch):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {}
    n, c = common.forest(np.array([a for a, b in edges if a != b]), np.array([b for a, b in edges if a != b]))
    want = dict(zip(n.tolist(), c.tolist()))
    for chunk in (7, 1000):
        got = {x.node: x.component for x in common.components(df, "t", chunk=chunk).collect()}
        assert got == want


def test_forest_against_search():
    r = random.Random(2)
    for _ in range(20):
        e = [(r.randrange(40), r.randrange(40)) for _ in range(30)]
        n, c = common.forest(np.array([a for a, _ in e]), np.array([b for _, b in e]))
        near = {}
        for a, b in e:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for x, low in zip(n.tolist(), c.tolist()):
            seen, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            assert min(seen) == low


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(4)
    err = []
    for j in (0.0, 0.5, 0.85, 0.95):
        for _ in range(20):
            both = int(400 * j)
            x = rng.integers(0, 1 << 63, 800 - both).astype(np.uint64)
            a, b = x[:400], np.concatenate([x[:both], x[400:]])
            sig = matrix([packed(minima(a)), packed(minima(b))])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            err.append(float(similarity(sig[0], sig[1])) - true)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.08


def test_shingles_follow_the_contract():
    assert len(shingles(None)) == len(shingles("")) == len(shingles(" \t\n")) == 0
    assert len(shingles("A b")) == 1 and shingles("A b").tolist() == shingles("a\x0bB").tolist()
    assert shingles("É b").tolist() != shingles("é b").tolist()
    assert shingles("a\x1cb c d e f").tolist() == shingles("a\x1cb  c d e f").tolist()
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a a a a a a a")) == 1
    assert shingles("a b").tolist() != shingles("a b a b a").tolist()


def test_odd_rows(docs, none):
    rows = near_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    want = sorted(exact(ROWS), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    assert near_dedup(none).count() == 0


def test_hot_copies_collapse_first(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"),
                                 F.expr("if(id % 3 = 0, 'a b c d e f g', concat('t ', id, ' u ', id, ' v w x'))").alias("text"))
    rows = near_dedup(d).collect()
    assert sum(r.kept for r in rows) == 4000 - 1334 + 1
