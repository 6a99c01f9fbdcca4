"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, user first, assistant last. Every input turn is kept under its
own or another role (relabel), continues the turn before it (merge), or is
preceded by empty turns (insert); empty turns may also close a conversation.
Dynamic programming over the states "role of the last turn" finds the cheapest
legal reading; ties go to the first action in the order of ``_moves``.

One turn is a 4 x 4 min-plus matrix, and matrices multiply: conversations are
cut into blocks of at most BLOCK turns in global order (conversation, turn).
Each block's matrix is computed where the block lies, a second step combines
the few matrices of a conversation and hands every block its entry and exit
state, and a third traces the turns of each block. A conversation of any
length is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import map_groups, split_runs
from panelforge.sources.io import stage

ROLES = ["system", "user", "assistant"]
START = 3                                    # state before the first turn
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 3, 1, 4
BLOCK = 2048
INF = 1e18

# Other names of the three roles (fixed values, free of cost).
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
           "ai": "assistant", "developer": "system"}

# Empty turns that must come between the last role and the next one.
GAP = {(START, 0): [], (START, 1): [], (START, 2): [1], (0, 1): [], (0, 2): [1], (1, 2): [], (1, 1): [2],
        (2, 1): [], (2, 2): [1]}
END_GAP = {START: [1, 2], 0: [1, 2], 1: [2], 2: []}


def role_number(role: str | None) -> int:
    """0 system, 1 user, 2 assistant, 3 unknown."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES else 3


@lru_cache(maxsize=None)
def _moves(role: int) -> tuple:
    """(from, to, cost, action, new role, empty turns before) of one turn."""
    out = []
    for state in (START, 0, 1, 2):
        for new in sorted(range(3), key=lambda q: q != role):
            price = 0 if new == role else (RELABEL_UNKNOWN if role == 3 else RELABEL)
            word = "keep" if new == role else "relabel"
            if (state, new) in GAP:
                gap = GAP[state, new]
                out.append((state, new, price + INSERT * len(gap), word, new, tuple(gap)))
            if state == new:
                out.append((state, new, price + MERGE, "merge" if new == role else "relabel+merge", new, ()))
    return tuple(sorted(out, key=lambda m: (m[1], m[2])))


@lru_cache(maxsize=None)
def _matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), INF)
    for a, b, cost, *_ in _moves(role):
        m[a, b] = min(m[a, b], cost)
    return m


def product(roles: list[int]) -> np.ndarray:
    """Min-plus product of the turns' matrices."""
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        m = np.minimum((m[:, :, None] + _matrix(r)[None]).min(axis=1), INF)
    return m


def trace(roles: list[int], entry: int, leave: int) -> list[tuple]:
    """Cheapest moves that read ``roles`` from state ``entry`` to ``leave``."""
    best = [INF] * 4
    best[entry] = 0
    steps = []
    for r in roles:
        nxt, how = [INF] * 4, [None] * 4
        for move in _moves(r):
            c = best[move[0]] + move[2]
            if c < nxt[move[1]]:
                nxt[move[1]], how[move[1]] = c, move
        best = nxt
        steps.append(how)
    out, state = [], leave
    for how in reversed(steps):
        move = how[state]
        out.append(move)
        state = move[0]
    return out[::-1]


def route(matrices: list[np.ndarray]) -> tuple[float, list[tuple[int, int]]]:
    """Total cost and (entry, exit) state of each block of a conversation."""
    best = np.full(4, INF)
    best[START] = 0
    back = []
    for m in matrices:
        t = best[:, None] + m
        back.append(t.argmin(axis=0))
        best = np.minimum(t.min(axis=0), INF)
    total = best + np.array([INSERT * len(END_GAP[s]) for s in range(4)])
    state = int(total.argmin())
    cost, out = float(total[state]), []
    for b in reversed(back):
        out.append((int(b[state]), state))
        state = int(b[state])
    return cost, out[::-1]


def repair_roles(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``conv``, ``turn``, role_in, role_out, action
    (keep, relabel, merge, relabel+merge), inserted_before, inserted_after
    (roles of empty turns, comma-joined), out_turn (number of the repaired
    turn it belongs to), conv_cost, piece (its part of the rendering).

    The pieces of a conversation in input order are its rendering: every turn
    as ``<|role|>\\ntext<|end|>\\n``, merged texts joined by a line break. Turns
    are ordered by ``turn`` (nulls last), ties by role and text; repeated rows
    are turns of their own. A null role is unknown and cheap to relabel, a null
    text is empty. Rows with a null ``conv`` form one conversation. An empty
    table gives an empty result. Extra columns are not read.
    """
    rows = turns.select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("t"),
                        F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    rows = (rows.select(F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.col("c").isNull().alias("cz"),
                        F.coalesce("t", F.lit(0).cast("long")).alias("t"), F.col("t").isNull().alias("tz"), "r", "x")
            .withColumn("h", F.xxhash64("x")))
    order = ["cz", "c", "tz", "t", "r", "h", "x"]

    def cut(frames):
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 40
        last, n = None, 0
        for f in frames:
            blocks, places = [], []
            for key in zip(f["cz"].tolist(), f["c"].tolist()):
                if key != last or n == block:
                    at, last, n = at + 1, key, 0
                blocks.append(at)
                places.append(n)
                n += 1
            yield f.drop(columns="h").assign(b=blocks, i=places)

    cuts = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInPandas(cut, "c long, cz boolean, t long, tz boolean, r string, x string, b long, i int"),
                 "chat_blocks")

    def matrices(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s, e in split_runs(f["b"].to_numpy()):
            m = product([role_number(x) for x in f["r"].iloc[s:e]])
            out.append((f["b"].iloc[s], f["c"].iloc[s], f["cz"].iloc[s], m.ravel().tolist()))
        return pd.DataFrame(out, columns=["b", "c", "cz", "m"])

    per = map_groups(cuts.select("b", "c", "cz", "r", "i"), "b", matrices,
                     "b long, c long, cz boolean, m array<double>", order=("i",))

    def routes(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        key = f["c"].to_numpy() * 2 + f["cz"].to_numpy()
        for s, e in split_runs(key):
            cost, states = route([np.array(m).reshape(4, 4) for m in f["m"].iloc[s:e]])
            for k, (a, z) in enumerate(states):
                out.append((f["b"].iloc[s + k], a, z, cost, k == len(states) - 1))
        return pd.DataFrame(out, columns=["rb", "enter", "leave", "cost", "final"])

    # one row per block here: a conversation's rows divided by BLOCK
    ways = stage(map_groups(per.withColumn("g", F.xxhash64("cz", "c")), "g", routes,
                            "rb long, enter int, leave int, cost double, final boolean", order=("cz", "c", "b")),
                 "chat_routes")

    def apply(f: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for s, e in split_runs(f["b"].to_numpy()):
            p = f.iloc[s:e]
            moves = trace([role_number(x) for x in p["r"]], int(p["enter"].iloc[0]), int(p["leave"].iloc[0]))
            new = np.cumsum([("merge" not in m[3]) + len(m[5]) for m in moves])
            last = [bool(p["final"].iloc[0]) and k == e - s - 1 for k in range(e - s)]
            after = [END_GAP[m[1]] if z else [] for m, z in zip(moves, last)]
            pieces = []
            for m, x, z, tail in zip(moves, p["x"], last, after):
                head = "".join(f"{_close(m[0], k)}<|{ROLES[q]}|>\n" for k, q in enumerate(m[5]))
                if "merge" in m[3]:
                    body = "\n" + x
                else:
                    body = f"{_close(m[0], len(m[5]))}<|{ROLES[m[4]]}|>\n{x}"
                close = "".join(f"<|end|>\n<|{ROLES[q]}|>\n" for q in tail) + "<|end|>\n" if z else ""
                pieces.append(head + body + close)
            parts.append(pd.DataFrame({
                "c": p["c"].to_numpy(), "cz": p["cz"].to_numpy(), "t": p["t"].to_numpy(), "tz": p["tz"].to_numpy(),
                "b": p["b"].to_numpy(), "role_in": p["r"].to_numpy(), "role_out": [ROLES[m[4]] for m in moves],
                "action": [m[3] for m in moves],
                "inserted_before": [",".join(ROLES[q] for q in m[5]) for m in moves],
                "inserted_after": [",".join(ROLES[q] for q in a) for a in after],
                "n": new, "cost": p["cost"].to_numpy(), "piece": pieces}))
        return pd.concat(parts, ignore_index=True)

    joined = cuts.join(ways, F.col("b") == F.col("rb")).select("c", "cz", "t", "tz", "r", "x", "b", "i",
                                                              "enter", "leave", "cost", "final")
    done = stage(map_groups(joined, "b", apply,
                            "c long, cz boolean, t long, tz boolean, b long, role_in string, role_out string, "
                            "action string, inserted_before string, inserted_after string, n long, cost double, "
                            "piece string", order=("i",)), "chat_turns")
    upto = Window.partitionBy("oc", "ocz").orderBy("ob").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (done.groupBy(F.col("b").alias("ob")).agg(F.max("n").alias("made"), F.first("c").alias("oc"),
                                                       F.first("cz").alias("ocz"))
               .withColumn("base", F.coalesce(F.sum("made").over(upto), F.lit(0))).select("ob", "base"))
    offsets = stage(offsets, "chat_offsets")
    return (done.join(offsets, F.col("b") == F.col("ob"))
            .select(F.when(~F.col("cz"), F.col("c")).alias(conv), F.when(~F.col("tz"), F.col("t")).alias(turn),
                    "role_in", "role_out", "action", "inserted_before", "inserted_after",
                    (F.col("base") + F.col("n") - 1).alias("out_turn"), F.col("cost").cast("long").alias("conv_cost"),
                    "piece"))


def _close(state: int, k: int) -> str:
    """End mark of the turn before, if there is one."""
    return "" if state == START and k == 0 else "<|end|>\n"
