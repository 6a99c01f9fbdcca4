"""Secret scan: fixed patterns plus a randomness test battery.

The battery looks at every run of TOKEN characters of MIN_LEN or more.

* Encoding: the smallest alphabet that holds all of the run's characters (hex,
  base 32, base 36, base 62, base 64); runs of digits only are not tested.
* Randomness: a chi-squared test that symbols are uniform over the alphabet, a
  runs test around the alphabet's middle and a lag-one serial correlation,
  joined to one chi-squared statistic with three degrees of freedom. Runs that
  it rejects at ALPHA are structured, not random.
* Against text: the corpus's own character bigrams (counted over all texts)
  give the likelihood ratio L of "uniform over the alphabet" to "text". Under
  text, P(L >= l) <= exp(-l) by Markov's inequality: a p-value that gets
  smaller with every further character.
* False discoveries: Benjamini-Hochberg at Q in each length class (powers of
  two), counting every run of that class as a test, so the many short words of
  a corpus raise the bar for short runs only. It works on a histogram of
  p-values: classes times bins rows, however many runs there are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import back, ids
from panelforge.sources.io import stage

# Fixed patterns of the contract: (kind, pattern, group that is measured, least length).
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
HEX_RUN = re.compile(r"[0-9a-f]{16,}")   # the hex matches that are long enough: a match is a whole run
KINDS = ["assign", "access", "hex", "random"]

TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
N = len(TOKEN) + 1        # token characters and "anything else" (0)
MIN_LEN = 20
ALPHA = 0.01
Q = 0.001
BIN = 0.25                # width of a bin, in decades of the p-value
BINS = 400

# Alphabets by size, in their own symbol order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def _table() -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for i, c in enumerate(TOKEN):
        t[ord(c)] = i + 1
    return t


_CLASS = _table()
_SETS = {k: (frozenset(_CLASS[ord(c)] for c in a), len(a)) for k, a in ALPHABETS.items()}
_PLACE = {}
for _k, _a in ALPHABETS.items():
    _p = np.zeros(N, dtype=np.int64)
    for _i, _c in enumerate(_a):
        _p[_CLASS[ord(_c)]] = _i
    _PLACE[_k] = _p
_DIGITS = frozenset(_CLASS[ord(c)] for c in "0123456789")


def classes(text: str) -> np.ndarray:
    """Class of each code point: 1.. for token characters, 0 for others."""
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(cp < 256, _CLASS[np.minimum(cp, 255)], 0).astype(np.uint8)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = []
    for kind, (name, pattern, group, least) in enumerate(BASE):
        if name == "hex":
            out += [(m.start(), kind, m.end()) for m in HEX_RUN.finditer(text)]
        elif name != "access" or "AKIA" in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(out)


def encoding(run: np.ndarray) -> str | None:
    have = frozenset(run.tolist())
    if have <= _DIGITS:
        return None
    for name, (alphabet, _) in _SETS.items():
        if have <= alphabet:
            return name
    return "base64"       # a mix of both base-64 alphabets


def randomness(symbols: np.ndarray, k: int) -> float:
    """p-value of the joined battery under "independent and uniform over k"."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=k)
    chi = k / n * float((counts.astype(np.float64) ** 2).sum()) - n
    z1 = (chi - (k - 1)) / np.sqrt(2.0 * (k - 1) * (n - 1) / n)
    high = symbols >= k / 2
    a = float(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        z2 = (1 + int((high[1:] != high[:-1]).sum()) - mean) / np.sqrt(var) if var > 0 else 0.0
    else:
        z2 = np.sqrt(n)   # one side only: n equal throws of a coin
    x = symbols - symbols.mean()
    s = float((x * x).sum())
    z3 = (float((x[1:] * x[:-1]).sum()) / s + 1.0 / n) * np.sqrt(n) if s else np.sqrt(n)
    q = max(z1, 0.0) ** 2 + z2 ** 2 + z3 ** 2
    return float(chi3_tail(q))


def chi3_tail(q: float) -> float:
    """P(chi-squared with 3 degrees of freedom > q)."""
    from math import erfc, exp, pi, sqrt
    return erfc(sqrt(q / 2)) + sqrt(2 * q / pi) * exp(-q / 2)


def runs_of(cls: np.ndarray) -> list[tuple[int, int]]:
    m = np.zeros(len(cls) + 2, dtype=np.int8)
    m[1:-1] = cls > 0
    edges = np.flatnonzero(np.diff(m))
    s, e = edges[0::2], edges[1::2]
    long = e - s >= MIN_LEN
    return list(zip(s[long].tolist(), e[long].tolist()))


def candidates(text: str, log_text: np.ndarray, floor: float):
    """Runs tested per length class, and those that may be discovered:
    (start, end, length class, bin of the p-value, encoding)."""
    cls = classes(text)
    tested: dict[int, int] = {}
    found = []
    for s, e in runs_of(cls):
        n = e - s
        stratum = n.bit_length()
        tested[stratum] = tested.get(stratum, 0) + 1
        run = cls[s:e]
        prev = np.empty(n, dtype=np.int64)
        prev[0] = cls[s - 1] if s else 0
        prev[1:] = run[:-1]
        text_ll = float(log_text[prev * N + run].sum())
        if -n * np.log(16) - text_ll < floor:     # not even over the smallest alphabet
            continue
        name = encoding(run)
        if name is None:
            continue
        k = _SETS[name][1]
        ratio = -n * np.log(k) - text_ll
        if ratio < floor or randomness(_PLACE[name][run], k) < ALPHA:
            continue
        found.append((s, e, stratum, int(min(BINS - 1, ratio / np.log(10) / BIN)), name))
    return tested, found


def text_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(character class | class before it) over all texts (add 1/2)."""
    def count(frames):
        total = np.zeros(N * N, dtype=np.int64)
        for f in frames:
            for t in f["t"]:
                if t:
                    c = classes(t).astype(np.int64)
                    total += np.bincount(np.concatenate([[0], c[:-1]]) * N + c, minlength=N * N)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"p": at, "n": total[at]})

    got = (docs.select(F.col(text).alias("t")).mapInPandas(count, "p long, n long")
           .groupBy("p").agg(F.sum("n").alias("n")).toPandas())   # at most N * N rows
    c = np.full(N * N, 0.5)
    c[got["p"].to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=np.float64)
    c = c.reshape(N, N)
    return np.log(c / c.sum(axis=1, keepdims=True)).ravel()


def thresholds(tested: dict[int, int], hist: dict[tuple[int, int], int], q: float = Q) -> dict[int, int]:
    """Benjamini-Hochberg per length class: the least bin that is discovered."""
    out = {}
    for stratum, m in tested.items():
        seen, least = 0, BINS
        for b in range(BINS - 1, -1, -1):
            seen += hist.get((stratum, b), 0)
            if seen and 10.0 ** (-b * BIN) <= q * seen / m:
                least = b
        out[stratum] = least
    return out


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = Q) -> DataFrame:
    """One row per input row: ``key``, n_assign, n_access, n_hex, base_sha256,
    spans (``kind:start:end``, code points, end exclusive, by start then kind),
    n_random.

    Null texts are empty: no span, the hash of the empty string. A random run
    that overlaps a fixed-pattern span is not repeated. Repeated rows are
    scanned alike. An empty table gives an empty result; columns other than
    ``key`` and ``text`` are not read.
    """
    log_text = text_model(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(log_text)
    floor = float(-np.log(q))                     # a larger p-value is never discovered

    def scan(frames):
        for f in frames:
            out = []
            for i, z, t in zip(f["id"], f["z"], f["t"]):
                t = t or ""
                base = base_spans(t)
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                n = [sum(k == j for _, k, _ in base) for j in range(3)]
                tested, found = candidates(t, shared.value, floor)
                found = [c for c in found if not any(c[0] < e and s < c[1] for s, _, e in base)]
                out.append((i, z, *n, hashlib.sha256(said.encode()).hexdigest(),
                            [{"s": s, "k": k, "e": e} for s, k, e in base],
                            [{"s": c[0], "e": c[1], "l": c[2], "b": c[3]} for c in found],
                            [{"l": a, "n": b} for a, b in tested.items()]))
            yield pd.DataFrame(out, columns=["id", "z", "n_assign", "n_access", "n_hex", "base_sha256",
                                             "base", "found", "tested"])

    rows = docs.select(*ids(key), F.col(text).alias("t"))
    scanned = stage(rows.mapInPandas(
        scan, "id long, z boolean, n_assign long, n_access long, n_hex long, base_sha256 string, "
              "base array<struct<s:int,k:int,e:int>>, found array<struct<s:int,e:int,l:int,b:int>>, "
              "tested array<struct<l:int,n:long>>"), "secret_scan")
    tested = {r.l: r.n for r in scanned.select(F.inline("tested")).groupBy("l").agg(F.sum("n").alias("n")).collect()}
    hist = {(r.l, r.b): r.n for r in scanned.select(F.inline("found")).groupBy("l", "b")
            .agg(F.count(F.lit(1)).alias("n")).collect()}   # at most length classes times BINS rows
    least = thresholds(tested, hist, q)
    limit = F.create_map(*[F.lit(x) for kv in (least or {0: BINS}).items() for x in kv])
    kept = F.transform(F.filter("found", lambda c: c["b"] >= F.element_at(limit, c["l"])),
                       lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat("base", "kept")),
                        lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"]))
    return (scanned.withColumn("kept", kept)
            .select(back(key), "n_assign", "n_access", "n_hex", "base_sha256",
                    F.array_join(spans, ",").alias("spans"), F.size("kept").cast("long").alias("n_random")))
