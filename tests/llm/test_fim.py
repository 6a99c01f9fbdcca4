import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm.fim import FORMS, MARKS, PieceTable, arrange, fill_in_middle, parse, plan, restore
from tests.llm.conftest import ROWS


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    """The contract, spelled out without pieces."""
    t = text or ""
    n = len(t)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    seq = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, a, b - a, sha(seq), sha(t)


ANY = st.text(st.sampled_from("<>PSM aé日\U0001F600\n"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ANY, st.integers(0, 40), st.integers(0, 40), st.sampled_from(sorted(FORMS)))
def test_round_trip_of_every_cut(text, a, b, form):
    if any(m in text for m in MARKS):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    table = arrange(text, form, a, b)
    assert restore(table.text(), form) == text
    assert parse(table.text(), form).sha256() == sha(text)
    assert table.sha256() == sha(table.text())


def test_cut_copies_nothing():
    t = PieceTable.of("abcdef").cut(2, 2)
    assert t.pieces == [(0, 0, 2), (0, 2, 0), (0, 2, 4)] and t.text() == "abcdef"
    order = (2, 0, 1)
    assert t.permute(order).inverse(order).pieces == t.pieces
    assert t.buffers[0] is t.permute(order).buffers[0]


def test_odd_rows(docs):
    got = Counter(tuple(r) for r in fill_in_middle(docs).collect())
    assert got == Counter(expected(r[0], r[1]) for r in ROWS)


def test_all_forms_and_sentinels(spark):
    rows = [(i, t) for i in range(400) for t in (f"text {i} of <some> length é日", f"with <M> {i}")]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_outputs_hold_the_sequences(docs):
    out = fill_in_middle(docs, outputs=True).withColumn("again", F.sha2("output", 256))
    for r in out.collect():
        assert r.again == r.output_sha256
        assert sum(p["length"] for p in r.pieces) == len(r.output)
        assert sha(restore(r.output, r.form)) == r.restored_sha256


def test_empty_table(none):
    assert fill_in_middle(none).count() == 0
    assert plan(5, "")[0] == "plain"
