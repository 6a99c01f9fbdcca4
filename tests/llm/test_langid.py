import random

import numpy as np

from panelforge.llm.langid import Counts, Space, classify, held_out, language_id, learn, trigrams
from tests.llm.conftest import ROWS

PARTS = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "ein", "ich", "ü"],
         "fr": ["eau", "oi", "é", "ment", "que"]}


def corpus(n, seed=0):
    r = random.Random(seed)
    word = lambda g: "".join(r.choice(PARTS[g]) for _ in range(r.randint(1, 4)))
    return [(i, " ".join(word(g) for _ in range(r.randint(5, 60))), g)
            for i in range(n) for g in [r.choice(sorted(PARTS))]]


def test_bundle_is_the_sum_of_bound_ngrams():
    s = Space(64, 1)
    texts = ["Abc abé, 12 xyz", "zzz", "日本語 日本"]
    for text, got in zip(texts, s.bundle([trigrams(t) for t in texts])):
        symbols = [0]
        for c in text.lower() + " ":
            if c.isalpha() or symbols[-1]:
                symbols.append(ord(c) if c.isalpha() else 0)
        want = np.zeros(64)
        for x, y, z in zip(symbols, symbols[1:], symbols[2:]):
            want += np.roll(s.letter(x), 2) * np.roll(s.letter(y), 1) * s.letter(z)
        assert got.tolist() == want.tolist()


def test_every_letter_has_its_own_vector():
    s = Space(1024)
    letters = [ord(c) for c in "azéüßñабвжящαβγδאבגक日本語𝒳"]
    v = np.stack([s.letter(c) for c in letters]).astype(int)
    cos = np.abs(v @ v.T / 1024 - np.eye(len(letters)))
    assert set(np.unique(v)) == {-1, 1} and cos.max() < 0.16
    assert (Space(1024).letter(ord("ж")) == s.letter(ord("ж"))).all()


def test_languages_of_one_script_are_told_apart(spark):
    r = random.Random(3)
    letters = {"x1": "абвгдежз", "x2": "жзиклмно", "y1": "αβγδεζηθ", "y2": "ηθικλμνξ"}
    rows = [(i, " ".join("".join(r.choices(letters[g], k=4)) for _ in range(12)), g)
            for i in range(400) for g in [r.choice(sorted(letters))]]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {i: g for i, _, g in rows}
    assert all(x.lang_pred == by[x.doc_id] for x in got if x.held_out)


def test_bounded_buffer_and_cache_change_nothing(monkeypatch):
    from panelforge.llm import langid
    texts = [t for _, t, _ in corpus(40)]
    codes = [trigrams(t) for t in texts]
    whole = Space(32).bundle(codes)
    u, n = np.unique(np.concatenate(codes), return_counts=True)
    monkeypatch.setattr(langid, "CACHED", 50)
    monkeypatch.setattr(langid, "HELD_GRAMS", 30)
    small = Space(32)
    assert (small.bundle(codes) == whole).all()
    assert (np.concatenate([small.bundle([c]) for c in codes]) == whole).all()
    c, sums = Counts(), {}
    frames = []
    for x in codes:
        if c.add("l", x):
            frames += list(c.take())
    for f in frames + list(c.take()):
        for g, k in zip(f["g"], f["n"]):
            sums[g] = sums.get(g, 0) + k
    assert len(frames) > 1 and sums == dict(zip(u.tolist(), n.tolist()))


def test_texts_without_letters():
    assert trigrams(None) is None and trigrams("") is None and trigrams("12 ,.\n") is None
    assert trigrams("a") is not None and trigrams("𝒳") is not None and trigrams("日本") is not None


def test_held_out_accuracy(spark):
    d = spark.createDataFrame(corpus(900), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(d).collect()}
    held = [(i, g) for i, _, g in corpus(900) if got[i].held_out]
    assert 200 < len(held) < 400
    assert np.mean([got[i].lang_pred == g for i, g in held]) > 0.97


def test_prototypes_equal_a_direct_bundle(spark):
    rows = corpus(60)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langs, protos = learn(d, dim=128)
    assert langs == sorted(PARTS)
    for g, p in zip(langs, protos):
        v = Space(128).bundle([np.concatenate([trigrams(t) for _, t, x in rows if x == g])])[0]
        assert np.allclose(p, v / np.linalg.norm(v))


def test_odd_rows(spark, docs):
    import zlib
    rows = language_id(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (2, 3, 4)} == {"und"} and by[2].score == 0
    assert by[9].lang_pred in ("en", "de", "fr")


def test_nothing_to_learn_and_empty_table(spark, none):
    assert language_id(none).count() == 0
    d = spark.createDataFrame([(0, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id(d).collect()] == [("und", 0.0)]
    assert classify(["abc"], [], np.zeros((0, 4)), 4)[0] == ["und"]
