import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode, suspects, fingerprints
from tests.llm.conftest import ROWS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), unique=True, max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), dtype=np.uint64)
    k, blob = golomb_encode(v)
    assert golomb_decode(blob, len(v), k).tolist() == v.tolist()


def test_golomb_is_small():
    rng = np.random.default_rng(0)
    v = np.unique(rng.integers(0, 1 << 32, 50_000).astype(np.uint64))
    k, blob = golomb_encode(v)
    assert len(blob) * 8 / len(v) < np.log2(2**32 / len(v)) + 2


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), first and i == keep, sha))
            first = False
    return out


def test_odd_rows(docs):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4], not r[3])
    assert sorted(got, key=key) == sorted(expected(ROWS), key=key)


def test_empty_table(none):
    assert exact_dedup(none).count() == 0


def test_large_group_of_copies(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same  text', concat('t', id)) as text")
    rows = exact_dedup(d.repartition(7)).collect()
    assert sum(r.kept for r in rows) == 2001
    assert {r.group_size for r in rows if r.doc_id % 3 == 0} == {1000}


def test_suspects_hold_every_copy(spark):
    d = spark.range(2000).selectExpr("id as doc_id", "concat('t', id % 1500) as text")
    fp = fingerprints(d.repartition(5), "doc_id", "text")
    got = {r.id for r in suspects(fp).collect()}
    assert got >= {i for i in range(2000) if i < 500 or i >= 1500}
    assert len(got) < 1100
