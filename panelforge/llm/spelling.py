"""Spelling variants: vocabulary acceptor o one-edit transducer o acceptor.

The pairs of words that differ by one inserted, deleted or replaced letter are
the pairs that the composition V o E o V accepts, V the minimised acceptor of
the vocabulary and E the transducer that copies letters and makes one edit.
V is never built whole. The composition is enumerated per initial state:

* A class L holds the words of L letters (short) and of L + 1 (long); every
  pair lies in one class, as two short words or as a short and a long one.
* A pair's edit is where the words first differ. A hole [lo, hi) of a class
  takes the pairs whose edit lies in it: such words share what is before the
  hole and what is after it. A partition is one shared (before, after): the
  state that ``before`` leads to is initial, the one that ``after`` begins at
  is final, and the acceptor between them spells what stands in the hole.
* Holes start as the two halves of the word. A partition of more than CELL
  words is cut into the partitions of both halves of its hole, and so on; with
  a hole of one letter, words of a partition differ in one letter only, so its
  size is bounded by the alphabet. No partition is capped or sampled.

In a partition the short and the long words each become a minimal acceptor
(equal states are one), and the composition is walked from the initial states:
copy, copy, one edit, then the common right language of the two states. Each
pair is found once, in one partition; a task sends on what each word saw in it
(near words, best one), not the pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import ids, map_groups, small_side, split_runs
from panelforge.sources.io import stage

MIN_LENGTH, MIN_COUNT = 5, 3
SLIP = 97                # of 97 values of the hash, one deletes a letter
CELL = 4096              # words of a partition that one walk takes
FLUSH = 300_000          # distinct words a task holds before it sends them on

# One byte a code point up to U+00FF: A-Z lower-cased, a-z and U+00C0 to
# U+00FF kept, the rest (and every later code point) separates.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Letter runs of a text, lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_BYTES).split() if text else []


def slipped(word: bytes, start: int, slip: int) -> bytes:
    """The run with one letter deleted when ``slip`` divides its hash; ``start``
    is the crc32 of ``<key>:``, which the run's bytes carry on."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % slip:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """Stored (word, n): words of at least ``min_length`` letters and
    ``min_count`` occurrences, counted over all texts."""
    def run(frames):
        held: Counter = Counter()
        for f in frames:
            for i, z, t in zip(f["id"].tolist(), f["z"].tolist(), f["t"]):
                start = zlib.crc32(b":" if z else b"%d:" % i)
                for w, n in Counter(runs(t)).items():
                    if len(w) >= min_length:
                        w = slipped(w, start, slip)
                        if len(w) >= min_length:
                            held[w] += n
                if len(held) >= FLUSH:
                    yield counted(held)
                    held.clear()
        yield counted(held)

    def counted(held):
        return pd.DataFrame({"word": pd.Series([w.decode("latin-1") for w in held], dtype=object),
                             "n": list(held.values())})

    n = docs.select(*ids(key), F.col(text).alias("t")).mapInPandas(run, "word string, n long")
    return stage(n.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "spelling_words")


class Acceptors:
    """Minimal acceptors over one register of states: a state is what can
    follow it, so states with equal right languages are one."""

    def __init__(self):
        self.final: list[bool] = []
        self.arcs: list[dict[int, int]] = []
        self._known: dict = {}

    def _state(self, final: bool, arcs: dict[int, int]) -> int:
        sign = (final, tuple(arcs.items()))
        s = self._known.get(sign)
        if s is None:
            s = self._known[sign] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return s

    def build(self, words: list[bytes]) -> int:
        """Initial state of the acceptor of sorted distinct words: states on the
        last word's path are open, and closed when the next word leaves it."""
        path: list[list] = [[False, {}]]     # [final, arcs] of each open state
        last = b""
        for w in words:
            same = 0
            end = min(len(last), len(w))
            while same < end and last[same] == w[same]:
                same += 1
            self._close(path, last, same)
            path += [[False, {}] for _ in range(len(w) - same)]
            path[-1][0] = True
            last = w
        self._close(path, last, 0)
        return self._state(*path[0])

    def _close(self, path, last, depth):
        for d in range(len(last), depth, -1):
            final, arcs = path.pop()
            path[-1][1][last[d - 1]] = self._state(final, arcs)

    def common(self, p: int, q: int):
        """Words of the right languages of both states."""
        todo = [(p, q, b"")]
        while todo:
            p, q, z = todo.pop()
            if self.final[p] and self.final[q]:
                yield z
            a, b = self.arcs[p], self.arcs[q]
            if len(b) < len(a):
                a, b = b, a
            for x, r in a.items():
                s = b.get(x)
                if s is not None:
                    todo.append((r, s, z + bytes((x,))))

    def replaced(self, p: int):
        """Pairs of one acceptor that differ by a replaced letter."""
        todo = [(p, b"")]
        while todo:
            p, z = todo.pop()
            arcs = list(self.arcs[p].items())
            for i, (x, r) in enumerate(arcs):
                for y, s in arcs[i + 1:]:
                    for rest in self.common(r, s):
                        yield z + bytes((x,)) + rest, z + bytes((y,)) + rest
                todo.append((r, z + bytes((x,))))

    def inserted(self, p: int, q: int, at_end: bool):
        """Pairs (word of p, the same with a letter inserted, of q); the letter
        is not the one that follows, so of equal letters the last is the new
        one. After the last letter only with ``at_end``."""
        todo = [(p, q, b"")]
        while todo:
            p, q, z = todo.pop()
            short, long = self.arcs[p], self.arcs[q]
            for y, s in long.items():
                if at_end and self.final[p] and self.final[s]:
                    yield z, z + bytes((y,))
                after = self.arcs[s]
                for x, r in short.items():
                    if x != y and x in after:
                        for rest in self.common(r, after[x]):
                            rest = bytes((x,)) + rest
                            yield z + rest, z + bytes((y,)) + rest
                if y in short:
                    todo.append((short[y], s, z + bytes((y,))))


def near_pairs(short: list[bytes], long: list[bytes], at_end: bool):
    """Pairs one edit apart within a partition: what stands in the hole of its
    short words, and of its long ones (sorted)."""
    m = Acceptors()
    p = m.build(short)
    yield from ((0, a, 0, b) for a, b in m.replaced(p))
    if long:
        yield from ((0, a, 1, b) for a, b in m.inserted(p, m.build(long), at_end))


def walk(f: pd.DataFrame) -> pd.DataFrame | None:
    """What each word sees in each partition of a frame: number of near words,
    and the largest of them (count, word)."""
    out = []
    part, role = f["part"].to_numpy(), f["role"].to_numpy()
    hole, end, words, counts = f["hole"].tolist(), f["at_end"].tolist(), f["word"].tolist(), f["n"].tolist()
    for a, b in split_runs(part):
        if b - a < 2 or role[a:b].all():
            continue
        of = ({}, {})
        for k in range(a, b):
            of[role[k]][hole[k].encode("latin-1")] = k
        seen: dict[int, list] = {}
        for r, x, s, y in near_pairs(sorted(of[0]), sorted(of[1]), end[a]):
            i, j = of[r][x], of[s][y]
            for u, v in ((i, j), (j, i)):
                got = seen.get(u)
                best = (-counts[v], words[v])
                if got is None:
                    seen[u] = [1, best]
                else:
                    got[0] += 1
                    if best < got[1]:
                        got[1] = best
        out += [(words[u], c, -neg, w) for u, (c, (neg, w)) in seen.items()]
    return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"], dtype=object) if out else None


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``part`` (class, hole, what is before and after it) and ``hole``
    (what stands in it) to rows (word, n, cls, role, lo, hi)."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.col("hi") + F.col("role") + 1, F.col("cls") - F.col("hi"))
    return rows.select(
        "*", F.concat_ws(":", "cls", "lo", "hi", before, after).alias("part"),
        F.substring("word", F.col("lo") + 1, F.col("hi") + F.col("role") - F.col("lo")).alias("hole"))


def _halved(rows: DataFrame, lo, hi) -> DataFrame:
    """Rows (word, n, cls, role) once for each half of the hole [lo, hi)."""
    mid = F.floor((lo + hi) / 2).cast("int")
    halves = F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))
    return _keyed(rows.select("word", "n", "cls", "role", F.inline(halves)))


def partitions(words: DataFrame, min_length: int, cell: int) -> DataFrame:
    """Stored rows (part, role, hole, at_end, word, n) of all partitions, each of
    at most ``cell`` words or with a hole of one letter."""
    size = F.char_length("word")
    classes = F.array(F.struct(size.alias("cls"), F.lit(0).alias("role")),
                      F.struct((size - 1).alias("cls"), F.lit(1).alias("role")))
    rows = words.select("word", "n", F.inline(classes)).where(F.col("cls") >= min_length)
    rows = stage(_halved(rows, F.lit(0), F.col("cls")), "spelling_parts")
    done = None
    while True:
        big = stage(rows.where("hi - lo > 1").groupBy("part").agg(F.count(F.lit(1)).alias("size"))
                    .where(F.col("size") > cell).select(F.col("part").alias("big")), "spelling_big")
        if big.isEmpty():
            break
        big = small_side(big, 96)
        on = F.col("part") == F.col("big")
        fits = rows.join(big, on, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = stage(_halved(rows.join(big, on, "left_semi"), F.col("lo"), F.col("hi")), "spelling_parts")
    done = rows if done is None else done.unionByName(rows)
    return done.select("part", "role", "hole", (F.col("hi") == F.col("cls")).alias("at_end"), "word", "n")


def followed(forms: DataFrame) -> DataFrame:
    """Stored (word, root): (word, form) followed to the last form, by doubling.
    Counts at least double at each step, so chains are short and end."""
    r = stage(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        nxt = r.select(F.col("word").alias("via"), F.col("root").alias("further"))
        r = stage(r.join(nxt, F.col("root") == F.col("via"), "left")
                  .select("word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved")),
                  "spelling_roots")
        if r.where("moved").isEmpty():
            return r.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, slip: int = SLIP, cell: int = CELL) -> DataFrame:
    """One row per word: word, form, root (strings), n, n_near, form_n (long).

    Words are letter runs of all texts, of at least ``min_length`` letters and
    ``min_count`` occurrences (n). n_near counts the words one edit away; form
    is the one of them with the largest n (ties: the first in code-point
    order) if that is at least 2 * n, form_n its count, root the end of the
    chain of forms (the word itself without one). Every ``slip``-th pair of
    key and run loses a letter, as the contract plants them. Null and empty
    texts hold no words, a null key hashes as empty, repeated rows count each
    time, other columns are not read.
    """
    words = vocabulary(docs, key, text, min_length, min_count, slip)
    seen = map_groups(partitions(words, min_length, cell), "part", walk,
                      "word string, n_near long, best_n long, best string")
    near = seen.groupBy(F.col("word").alias("w")).agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("neg"), "best")).alias("b"))
    good = -F.col("b.neg") >= 2 * F.col("n")
    table = stage(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("b.best")).alias("form"),
        F.when(good, -F.col("b.neg")).alias("form_n")), "spelling_near")
    roots = followed(table.where("form is not null")).select(F.col("word").alias("w"), "root")
    return table.join(roots, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
