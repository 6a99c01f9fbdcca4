import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm.spelling import Acceptors, followed, near_pairs, runs, spelling_variants
from tests.llm.conftest import ROWS


def near(a, b):
    """Exactly one inserted, deleted or replaced letter apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def letters(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[a-zÀ-ÿ]+", low)


def counts(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for w in letters(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(rows):
    n = counts(rows)
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n_docs, vocabulary, alphabet):
    """Few words, worn by edits, so that chains, ties and dense groups arise."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(3, 9))) for _ in range(vocabulary)]
    rows = []
    for i in range(n_docs):
        ws = []
        for _ in range(60):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.4:
                p = rng.randrange(len(w) + 1)
                w = rng.choice([w[:p] + rng.choice(alphabet) + w[p:], w[:p] + w[p + 1:],
                                w[:p] + rng.choice(alphabet) + w[p + 1:]])
            ws.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "\n", "-", "9", "日"]).join(ws)))
    return rows


def test_against_all_pairs(spark):
    for seed, n_docs, size, alphabet in ((1, 120, 60, "ab"), (3, 120, 200, "abcdefghijÿ×")):
        rows = corpus(seed, n_docs, size, alphabet)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want = brute(rows)
        assert len(want) > 50
        assert got(spelling_variants(d)) == want


def test_partitions_cut_again_give_the_same(spark):
    rows = corpus(2, 150, 80, "abcé")
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert any(r[1] != r[2] for r in want if r[1])
    assert got(spelling_variants(d, cell=4)) == want


def test_odd_rows(docs):
    assert got(spelling_variants(docs)) == brute(ROWS)


def test_long_runs_and_a_hot_prefix(spark):
    stem = "a" * 3000
    rows = [(i, f"{stem}x {stem} {stem}y b{stem} " + " ".join(f"samestem{k:c}{j:c}" for k in range(97, 123)
                                                             for j in range(97, 105))) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(spelling_variants(d, cell=50)) == want
    assert sum(r[4] for r in want) > 5000


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=3)), st.sets(st.text("ab", min_size=4, max_size=4)))
def test_composition_of_small_acceptors(short, long):
    pairs = [(r, a.decode(), s, b.decode()) for r, a, s, b in
             near_pairs(sorted(w.encode() for w in short), sorted(w.encode() for w in long), True)]
    assert len(pairs) == len(set(pairs))
    found = {frozenset((a, b)) for _, a, _, b in pairs}
    words = sorted(short) + sorted(long)
    assert found == {frozenset((a, b)) for a in short for b in words if near(a, b)}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", max_size=5), max_size=40))
def test_acceptor_is_minimal_and_whole(words):
    m = Acceptors()
    s = m.build(sorted(w.encode() for w in words))
    assert sorted(m.common(s, s)) == sorted(w.encode() for w in words)
    assert m.build(sorted(w.encode() for w in words)) == s
    right = {}
    for state in range(len(m.final)):
        lang = frozenset(m.common(state, state))
        assert right.setdefault(lang, state) == state


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_runs(text):
    assert [w.decode("latin-1") for w in runs(text)] == letters(text)


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {r.root for r in followed(forms).collect()} == {"w40"}


def test_empty_table(none):
    assert spelling_variants(none).count() == 0
