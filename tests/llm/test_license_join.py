import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm.license_join import PHRASES, TEMPLATES, Template, license_blocks, license_scan, places, words
from tests.llm.conftest import ROWS


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def sets_of(templates):
    for label, threshold, text in templates:
        w = plain_words(text)
        win = 2
        while win < 2 * len(w):
            win *= 2
        yield label, threshold, set(w), win


def brute_blocks(text, templates):
    """(number, window, start, containment) of every block against every template."""
    w = plain_words(text)
    out = set()
    for no, (label, threshold, t, win) in enumerate(sets_of(templates)):
        for s in range(0, len(w), win // 2):
            c = len(t & set(w[s:s + win])) / len(t)
            if c >= threshold - 1e-9:
                out.add((no, win, s, round(c, 9)))
    return out


def brute(text, templates=TEMPLATES):
    w = plain_words(text)
    at, base = [], set()
    for label, p in PHRASES:
        p = p.split()
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                at.append(i)
                base.add(label)
    met = brute_blocks(text, templates)
    labels = base | {templates[m[0]][0] for m in met}
    score = 1.0 if at else max([m[3] for m in met], default=0.0)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), round(score, 9))


def rows_of(df):
    key = lambda r: (r[0] is None, r)
    return sorted([(*r[:-1], round(r[-1], 9)) for r in df.collect()], key=lambda r: (r[0] is None, str(r)))


def want(rows, templates=TEMPLATES):
    return sorted([(r[0], *brute(r[1], templates)) for r in rows], key=lambda r: (r[0] is None, str(r)))


def noisy(rng, n_docs):
    """Notices, whole and worn, within words that templates hold too."""
    fill = ["the", "of", "license", "software", "Mit", "MIT", "apache", "under", "foo", "bär", "x9", "日本", "and", "2", "0",
            "permission", "general", "public", "gnu", "redistribution"]
    rows = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choices(fill, k=rng.randint(0, 90))
            notice = rng.choice(TEMPLATES)[2].split()
            drop = rng.choice([0, 0, 0.1, 0.2, 0.3])
            parts += [w for w in notice if rng.random() >= drop]
        rows.append((i, rng.choice([" ", "\n", ", "]).join(parts)))
    return rows


def test_against_every_block_and_template(spark):
    rows = noisy(random.Random(12), 150)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(license_scan(d)) == want(rows)
    got = {(r.doc_id, r.template, r.window, r.start, round(r.containment, 9)) for r in license_blocks(d).collect()}
    assert got == {(i, *m) for i, t in rows for m in brute_blocks(t, TEMPLATES)}
    assert len(got) > 100


def test_odd_rows(docs):
    assert rows_of(license_scan(docs)) == want(ROWS)


def test_notice_at_any_place_is_found(spark):
    rows = [(i, "x " * i + TEMPLATES[-2][2] + " y" * 50) for i in range(0, 130)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("mpl" in r.labels and r.score == 1.0 for r in got)


def test_other_templates_and_ties(spark):
    own = [("a", 0.5, "one two three four"), ("b", 0.5, "four three two one"), ("c", 1.0, "one")]
    rows = [(1, "two one zero"), (1, "two one zero"), (2, "four"), (3, "ONE")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(license_scan(d, templates=own)) == want(rows, own)
    with pytest.raises(ValueError):
        Template("d", 0.5, "--")


def test_phrase_places():
    j = b" mit license mit license license mit license "
    assert places(j, b" mit license ") == [0, 2, 5]
    assert places(b"  ", b" mit license ") == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in words(text)] == plain_words(text)


def test_empty_table(none):
    assert license_scan(none).count() == 0
