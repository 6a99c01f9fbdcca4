"""The pipeline against a brute-force version of its stages."""
import random
import re
import zlib

import pytest

import corpus_pipeline as P
from panelforge.llm import stages as S
from tests.llm.conftest import ROWS
from tests.llm.test_langid import PARTS
from tests.llm.test_minhash import exact as near_exact


def corpus():
    r = random.Random(11)
    rows = []
    for i in range(150):
        g = r.choice(sorted(PARTS))
        text = " ".join("".join(r.choice(PARTS[g]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 90)))
        rows.append((i, text, g, r.choice(["a", "b", "c", None]), len(text)))
    for i in range(150, 210):
        _, text, g, s, n = rows[r.randrange(150)]
        if i % 2:
            text = text.replace(" ", "  ", 2)
        else:
            w = text.split()
            w[r.randrange(len(w))] = "zzz"
            text = " ".join(w)
        rows.append((i, text, g, s, n))
    return rows + [(210, None, "en", "a", 0), (211, "123 456", "en", "b", 7), (212, "", None, None, 0)]


def test_stages_against_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    a = S.language_id(spark, d, "")
    assert {r.doc_id for r in a.collect()} == set(range(210)) and a.columns == d.columns
    b = S.exact(spark, a, "")
    seen, keep = set(), []
    for row in rows[:210]:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", row[1])
        if norm not in seen:
            keep.append(row)
        seen.add(norm)
    assert sorted(tuple(r) for r in b.collect()) == sorted(keep, key=lambda r: r[0])
    c = S.near(spark, b, "")
    ids = {i for i, _, low in near_exact(keep) if i == low}
    assert {r.doc_id for r in c.collect()} == ids and c.columns == d.columns
    m = S.mixing_stage(spark, c, "")
    assert m.columns == d.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    from panelforge.llm.mixing import mix
    taken = {r.doc_id: r.taken for r in mix(c).collect()}
    got = {}
    for r in m.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + size(r.text)
    assert got == {i: n for i, n in taken.items() if n}
    p = S.packing(spark, m, "").collect()
    from panelforge.llm.tokens import word_ids
    enc = word_ids("word_bpe_49k.json")
    want = sum(len(enc.text(r.text)) // 4 + 1 for r in m.collect())
    assert sum(r.length for r in p) == want


def test_near_stage_joins_pairs_from_080_to_085(spark):
    rows = []
    for g in range(12):
        w = [f"v{g}x{i}" for i in range(49 + g)]     # 45 + g shingles, five of them differ
        other = [*w[:20], "zzz", *w[21:]]
        same = len(w) - 9
        assert 0.80 <= same / (same + 10) < 0.85
        rows += [(2 * g, " ".join(w), "en", "a", 0), (2 * g + 1, " ".join(other), "en", "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in dict(P.STAGES)["minhash_near_dedup"](spark, d, "").collect()}
    assert got == {i for i, _, low in near_exact(rows, 80) if i == low} == set(range(0, 24, 2))


def test_run_equals_the_stages_in_a_row(spark, tmp_path):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    a = P.run(spark, str(tmp_path))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, f) in enumerate(P.STAGES):
        f(spark, df, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        df = spark.read.parquet(str(tmp_path / str(i)))
    total = lambda x: sum(r.length for r in x.collect())
    assert total(a) == total(df) > 0


def test_odd_rows_and_empty_tables(spark, docs, none):
    for d in (docs, none):
        kept = d.columns
        for _, f in P.STAGES:
            d = f(spark, d, "")
            if f is not S.packing:
                assert d.columns == kept
        d.collect()


@pytest.mark.parametrize("stage", [S.exact, S.near])
def test_repeated_rows_leave_one(spark, docs, stage):
    rows = stage(spark, docs, "").collect()
    assert sum(r.doc_id == 7 for r in rows) <= 1
    assert sum(r.doc_id is None for r in rows) == 1
    assert len(rows) < len(ROWS) and zlib.crc32(b"") == 0
