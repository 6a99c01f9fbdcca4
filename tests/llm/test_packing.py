import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm.packing import Packer, pack
from panelforge.llm.tokens import WordIds, tokenizer_file
from tests.llm.conftest import ROWS

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file(NAME))
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return WordIds(NAME)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'sßéÀÑ .,\n\t\x1c\x85 <|endoftext>019İΣσ́", max_size=40)))
def test_cached_words_give_the_tokenizers_ids(words, reference, text):
    assert np.frombuffer(words.text(text), "<u4").tolist() == reference(text)


def check(pieces, docs):
    seq = {}
    for p in pieces:
        seq.setdefault(p["sequence_id"], []).append(p)
    for ps in seq.values():
        ps.sort(key=lambda p: p["offset"])
        at = 0
        for p in ps:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == ps[0]["tier"] and at & (at - 1) == 0 and at <= 4096
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert set(by) == set(docs)
    for k, ids in docs.items():
        ps = sorted(by[k], key=lambda p: p["start"])
        n = len(ids[0])
        assert sum(p["length"] for p in ps) == n * len(ids)
        for p in ps:
            b = np.array(ids[0][p["start"]:p["start"] + p["length"]], dtype="<u4").tobytes()
            assert zlib.crc32(b) == p["ids_crc32"] and p["doc_tokens"] == n


def test_odd_rows(docs, reference):
    got = [r.asDict() for r in pack(docs).collect()]
    want = {}
    for i, t, *_ in ROWS:
        want.setdefault(i, []).append(reference(t or "") + [2])
    check(got, want)


def test_empty_table(none):
    assert pack(none).count() == 0


def test_small_buffers_and_step_groups(spark):
    d = spark.range(600).selectExpr("id as doc_id", "repeat('alpha beta ', cast(pow(id % 60, 2) as int)) as text")
    rows = pack(d.repartition(3), buffer_tokens=20_000, step_tokens=16_384).collect()
    firsts = {}
    for r in rows:
        if r.offset == 0:
            firsts.setdefault(r.tier, {}).setdefault(r.step, 0)
            firsts[r.tier][r.step] += r.tier
    for tier, steps in firsts.items():
        if tier >= 512:
            assert all(n == 16_384 for s, n in steps.items() if s < max(steps))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.integers(1, 30_000))
def test_packer_keeps_every_id(lengths, buffer_tokens):
    p = Packer(3, buffer_tokens=buffer_tokens)
    docs = {}
    for i, n in enumerate(lengths):
        ids = list(range(i, i + n))
        docs[i] = [ids]
        p.add(i, np.array(ids, dtype="<u4").tobytes())
    p.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "part", "no"]
    check([dict(zip(names, r)) for r in p.take_rows()], docs)
