import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm.toxicity import (Words, contexts, distinct_contexts, learn, logistic, ratios, statistics,
                                     toxicity)
from tests.llm.conftest import ROWS

BAD = ["scum", "moron", "idiot", "worthless"]


def corpus(n, seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(20, 120))
        bad = int(r.random() < 0.25)
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), bad))
    return rows


def tables(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return d.select("doc_id", "text"), d.select("doc_id", "toxic")


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    got = {r.doc_id: r for r in toxicity(*tables(spark, rows)).collect()}
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 250
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97


def test_held_out_labels_are_not_read(spark):
    rows = corpus(600)
    docs, labels = tables(spark, rows)
    a = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    held = {r.doc_id for r in toxicity(docs, labels).where("held_out").collect()}
    other = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    b = {r.doc_id: r.score for r in toxicity(docs, other).collect()}
    assert a == pytest.approx(b)


def test_copies_count_once():
    w = Words()
    a = w.text("one two three two one two")
    k = distinct_contexts(np.tile(a, 2), np.tile(contexts(a), 2), np.ones(12, dtype=np.int8))
    counts = {x: int((k["w"] == w.known[x]).sum()) for x in ("one", "two", "three")}
    assert counts == {"one": 2, "two": 2, "three": 1} and (k["y"] == 1).all()


def test_model_against_the_formula(spark):
    n0, n1 = [50, 3, 0, 7, 1], [5, 0, 6, 1, 1]
    m = ratios(spark.createDataFrame(list(zip(range(5), n0, n1)), "w long, n0 long, n1 long"), discount=2.0)
    t0, t1 = sum(n0), sum(n1)
    s = [x + y + 0.5 for x, y in zip(n0, n1)] + [0.5]
    p = []
    for n, t, d in ((n0, t0, 2.0 * t0 / t1), (n1, t1, 2.0)):
        cut = sum(min(x, d) for x in n) / t
        p.append([max(x - d, 0) / t + cut * q / sum(s) for x, q in zip([*n, 0], s)])
        assert sum(p[-1]) == pytest.approx(1.0)
    want = [np.log(b / a) for a, b in zip(*p)]
    got = {r.w: r.r for r in m.table.collect()}
    assert got == pytest.approx({i: want[i] for i in (0, 2)})
    assert m.default == pytest.approx(want[5]) and [want[i] for i in (1, 3, 4)] == pytest.approx([m.default] * 3)
    weight = sorted(zip(want[:5], [x + y for x, y in zip(n0, n1)]))
    below = np.cumsum([n for _, n in weight])
    assert m.background == pytest.approx(weight[int(np.searchsorted(below, below[-1] / 2))][0], abs=6e-4)


def test_statistics_against_plain_loops():
    r = random.Random(4)
    for _ in range(200):
        x = [r.choice([-1.0, 0.0, 0.3, 2.0, 4.0]) for _ in range(r.randint(1, 30))]
        got = statistics(*[np.array(v) for v in np.unique(x, return_counts=True)], background=0.1)
        centre = min(sorted(x)[(len(x) - 1) // 2], 0.1)
        assert got[0] == pytest.approx(sum(x) / len(x) - 0.1)
        assert got[1] == pytest.approx(sum(max(0.0, v - centre - 1.5) for v in x) / len(x) ** 0.5)
    assert statistics(np.zeros(0), np.zeros(0, dtype=int), 0.1) == (0.0, 0.0)


def test_scores_against_brute_force_by_join_and_by_table(spark):
    rows = corpus(300) + [(300, None, 0), (301, "", 1), (302, ". , !", 0), (303, "scum scum", 1), (303, "scum scum", 1)]
    d = spark.createDataFrame([(t, y, i % 5 == 0) for i, t, y in rows], "t string, y int, cal boolean")
    near, far = learn(d), learn(d, near_bytes=0)
    assert near.table.count() and near.curve == pytest.approx(far.curve)
    w = Words()
    table = {r.w: r.r for r in near.table.collect()}
    text = F.coalesce("t", F.lit(""))
    texts = d.select(text.alias("t"), text.alias("name"))
    got = [{(r.name, round(r.mean, 9), round(r.excess, 9)) for r in m.measure(texts, "name string").collect()}
           for m in (near, far)]
    want = set()
    for _, t, _ in rows:
        x = [table.get(k, near.default) for k in w.text(t).tolist()]
        if not x:
            want.add((t or "", 0.0, 0.0))
            continue
        centre = min(sorted(x)[(len(x) - 1) // 2], near.background)
        want.add((t, round(sum(x) / len(x) - near.background, 9),
                  round(sum(max(0.0, v - centre - 1.5) for v in x) / len(x) ** 0.5, 9)))
    for g in got:
        assert len(g) == len(want)
        for a, b in zip(sorted(g), sorted(want)):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-7)
    assert far.measure(texts, "name string").count() == len(rows)


def test_texts_of_mostly_toxic_words_stand_out(spark):
    rows = corpus(1500)
    m = learn(spark.createDataFrame([(t, y, i % 5 == 0) for i, t, y in rows], "t string, y int, cal boolean"))
    short = ["scum", "scum moron", "idiot " * 10, "w1 moron idiot", "w1 w2 scum worthless", " ".join(BAD)]
    texts = [(t, 0) for _, t, y in rows if not y] + [(t, 1) for t in short] + [("w1", 2)]
    got = m.measure(spark.createDataFrame(texts, "t string, k int"), "k int").withColumn("s", m.score()).collect()
    plain = max(r.excess for r in got if r.k == 0)
    assert all(r.excess > max(plain, 0.5) and r.s >= 0.3 for r in got if r.k == 1)
    assert all(r.excess <= plain and r.s < 0.3 for r in got if r.k == 2)


def test_logistic_fits_counts():
    x = np.array([0.0, 1.0, 2.0])
    a, b = logistic(x, np.array([10.0, 50.0, 90.0]), np.array([90.0, 50.0, 10.0]), ridge=0.0)
    assert a == pytest.approx(np.log(9)) and b == pytest.approx(-np.log(9))


def test_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert (r.mean, r.excess) == (0, 0) or r.doc_id not in (2, 3, 4)
    assert toxicity(none, labels).count() == 0
    assert toxicity(docs, labels.limit(0)).count() == len(ROWS)
