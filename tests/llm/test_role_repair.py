import itertools
import random

import pytest

from panelforge.llm.role_repair import (END_GAP, GAP, INSERT, MERGE, RELABEL, RELABEL_UNKNOWN, ROLES, START,
                                        repair_roles, role_number)


def cheapest(roles):
    """Least cost over all choices of a role and of merging for every turn."""
    best = None
    for choice in itertools.product([(q, m) for q in range(3) for m in (False, True)], repeat=len(roles)):
        state, cost = START, 0
        for r, (q, merged) in zip(roles, choice):
            cost += 0 if q == r else (RELABEL_UNKNOWN if r == 3 else RELABEL)
            if merged:
                if state != q:
                    break
                cost += MERGE
            else:
                if (state, q) not in GAP:
                    break
                cost += INSERT * len(GAP[state, q])
            state = q
        else:
            cost += INSERT * len(END_GAP[state])
            best = cost if best is None else min(best, cost)
    return best


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|") if not x.startswith("end") and x]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2) and text.endswith("<|end|>\n")


NAMES = ["system", "user", "assistant", "oracle"]


def conversations(n, seed):
    r = random.Random(seed)
    return {c: [r.randrange(4) for _ in range(r.randint(1, 4))] for c in range(n)}


@pytest.mark.parametrize("block", [2048, 2])
def test_cost_against_all_readings(spark, block):
    conv = conversations(80, 1)
    rows = [(c, t, NAMES[x], f"t{c}.{t}") for c, rs in conv.items() for t, x in enumerate(rs)]
    random.Random(0).shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = repair_roles(d, block=block).orderBy("conv_id", "turn").collect()
    assert len(got) == len(rows)
    for c, rs in conv.items():
        mine = [r for r in got if r.conv_id == c]
        assert {r.conv_cost for r in mine} == {cheapest(rs)}
        text = "".join(r.piece for r in mine)
        assert legal(text)
        assert text.count("<|end|>") == mine[-1].out_turn + 1 + len([x for x in mine[-1].inserted_after.split(",") if x])
        for r in mine:
            assert r.role_in == NAMES[rs[r.turn]] and f"t{c}.{r.turn}" in r.piece
            if r.action in ("keep", "merge"):
                assert r.role_in == r.role_out


def test_legal_conversations_cost_nothing(spark):
    d = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")],
                              "conv_id long, turn long, role string, text string")
    got = repair_roles(d).orderBy("turn").collect()
    assert [r.conv_cost for r in got] == [0, 0, 0]
    assert "".join(r.piece for r in got) == "<|system|>\na<|end|>\n<|user|>\nb<|end|>\n<|assistant|>\nc<|end|>\n"


def test_one_long_conversation_over_many_blocks(spark):
    roles = [random.Random(7 + i).choice(NAMES[:3]) for i in range(900)]
    d = spark.createDataFrame([(5, i, r, "x") for i, r in enumerate(roles)],
                              "conv_id long, turn long, role string, text string").repartition(6)
    a = [tuple(r) for r in repair_roles(d, block=16).orderBy("turn").collect()]
    b = [tuple(r) for r in repair_roles(d, block=100_000).orderBy("turn").collect()]
    assert [r[8] for r in a] == [r[8] for r in b]          # the same cost
    for rows in (a, b):
        assert legal("".join(r[9] for r in rows))


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, b int, kept string"
    rows = [(None, None, None, None, 1, "x"), (None, 1, "Human", "hi", 1, "x"), (2, 0, " USER ", "", 1, "x"),
            (2, 0, " USER ", "", 1, "x"), (2, None, "gpt", "w " * 200_000, 1, "x"), (3, 0, "tool", "z", 1, "x")]
    got = repair_roles(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {c: [r for r in got if r.conv_id == c] for c in (None, 2, 3)}
    assert [len(by[c]) for c in (None, 2, 3)] == [2, 3, 1]
    assert {r.conv_cost for r in by[3]} == {RELABEL_UNKNOWN + INSERT}
    assert repair_roles(spark.createDataFrame([], schema)).count() == 0
    assert role_number("Bot") == ROLES.index("assistant") and role_number(None) == 3
