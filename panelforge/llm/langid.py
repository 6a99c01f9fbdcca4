"""Language ID by hyperdimensional profiles.

Every letter has a random +1/-1 vector of its own, seeded by its code point. An
n-gram of three letters is bound by multiplying the letters' vectors, rotated by
their place; a text (or all training texts of a language) bundles its n-grams by
addition. A document goes to the language whose prototype has the largest cosine
with it.

Bundling is linear, so it works on n-gram counts: training sums counts per
(language, n-gram) in Spark, every task bundles the n-grams dealt to it, and the
tasks' vectors are added (sums of whole numbers: exact in any order); a document
batch is one product of its counts with the vectors of the n-grams it has.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, back, claim, ids
from panelforge.sources.io import stage

DIM = 1024
SEED = 5
MAX_BINS = 2_000_000   # cells of a batch's count matrix
BATCH_GRAMS = 500_000  # n-grams of the documents that are bundled together
HELD_GRAMS = 500_000   # distinct (language, n-gram) counts that a training task holds
CACHED = 65_536        # bound n-grams that a Python worker keeps
UND = "und"


PLACE = 21             # bits of a code point in an n-gram's code


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Each code point itself if it is a letter, else 0 (the gap)."""
    t = np.arange(0x110000, dtype=np.int32)
    letter = [unicodedata.category(chr(cp))[0] == "L" for cp in range(0x110000)]
    return np.where(letter, t, 0).astype(np.int32)


def trigrams(text: str | None) -> np.ndarray | None:
    """Codes of the text's letter trigrams (three code points in 63 bits), words
    framed by the gap; None for a null text or one without a letter."""
    if not text:
        return None
    s = letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not s.any():
        return None
    s = np.concatenate([np.zeros(1, np.int32), s, np.zeros(1, np.int32)])
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)       # runs of gaps become one
    s = s[keep].astype(np.int64)
    return (s[:-2] << 2 * PLACE) | (s[1:-1] << PLACE) | s[2:]


class Space:
    """Letter vectors, and bound n-gram vectors made when first seen."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.zeros(0, dtype=np.int64)          # sorted
        self.vectors = np.zeros((0, dim), dtype=np.int8)  # beside the codes

    def letter(self, cp: int) -> np.ndarray:
        v = self.letters.get(cp)
        if v is None:
            if len(self.letters) >= CACHED:
                self.letters.clear()
            v = np.random.default_rng([self.seed, cp]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            self.letters[cp] = v
        return v

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dim), dtype=np.int8)
        for place in range(3):
            cps, at = np.unique((codes >> (2 - place) * PLACE) & ((1 << PLACE) - 1), return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), 2 - place) for c in cps])[at]
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct codes; those not known yet are bound and kept."""
        if len(codes) > CACHED:
            return self.bind(codes)
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) + len(new) > CACHED:
                self.codes, self.vectors, new = self.codes[:0], self.vectors[:0], codes
            every = np.concatenate([self.codes, new])
            order = np.argsort(every, kind="stable")
            self.vectors = np.concatenate([self.vectors, self.bind(new)])[order]
            self.codes = every[order]
        return self.vectors[np.searchsorted(self.codes, codes)]

    def bundle(self, docs: list[np.ndarray]) -> np.ndarray:
        """One bundled vector per document (list of n-gram codes)."""
        out = np.empty((len(docs), self.dim), dtype=np.float32)
        used, col = np.unique(np.concatenate(docs), return_inverse=True)
        vec = self.rows(used).astype(np.float32) if len(used) <= CACHED else None
        size = np.array([len(d) for d in docs])
        step = max(1, MAX_BINS // max(1, len(used)))
        start = np.concatenate([[0], np.cumsum(size)])
        for i in range(0, len(docs), step):
            j = min(len(docs), i + step)
            at = np.repeat(np.arange(j - i), size[i:j]) * len(used) + col[start[i]:start[j]]
            n = np.bincount(at, minlength=(j - i) * len(used)).reshape(j - i, len(used)).astype(np.float32)
            if vec is not None:
                out[i:j] = n @ vec
            else:                                        # a text of very many n-grams: block by block
                out[i:j] = sum(n[:, k:k + 8192] @ self.bind(used[k:k + 8192]).astype(np.float32)
                               for k in range(0, len(used), 8192))
        return out


_SPACES: dict = {}


def space(dim: int, seed: int) -> Space:
    """One per Python worker."""
    claim("langid", _SPACES.clear)
    if (dim, seed) not in _SPACES:
        _SPACES[(dim, seed)] = Space(dim, seed)
    return _SPACES[(dim, seed)]


class Counts:
    """Counts of n-grams per language, in a bounded buffer."""

    def __init__(self):
        self.raw: dict[str, list] = {}
        self.sums: dict[str, tuple] = {}
        self.waiting = self.held = 0

    def add(self, lang: str, codes: np.ndarray) -> bool:
        """Whether the buffer is full."""
        self.raw.setdefault(lang, []).append(codes)
        self.waiting += len(codes)
        if self.waiting > 2 * HELD_GRAMS:
            self.fold()
        return self.held > HELD_GRAMS

    def fold(self):
        for g, parts in self.raw.items():
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            if g in self.sums:
                old, k = self.sums[g]
                u, at = np.unique(np.concatenate([old, u]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([k, n])).astype(np.int64)
            self.sums[g] = u, n
        self.raw, self.waiting = {}, 0
        self.held = sum(len(u) for u, _ in self.sums.values())

    def take(self):
        self.fold()
        for g, (u, n) in self.sums.items():
            yield pd.DataFrame({"l": g, "g": u, "n": n})
        self.sums, self.held = {}, 0


def learn(train: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM,
          seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from every row of ``train``
    with a non-null language. One vector a language comes to the driver; a column
    with so many values that these exceed BROADCAST_BYTES is refused."""
    def count(frames):
        c = Counts()
        for f in frames:
            for t, g in zip(f["t"], f["l"]):
                codes = trigrams(t)
                if codes is not None and c.add(g, codes):
                    yield from c.take()
        yield from c.take()

    def bundle(frames):
        s = Space(dim, seed)
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for g, part in f.groupby("l", sort=False):
                codes, n = part["g"].to_numpy(), part["n"].to_numpy(dtype=np.float64)
                v = sums.setdefault(g, np.zeros(dim))
                for i in range(0, len(codes), 4096):
                    v += n[i:i + 4096] @ s.bind(codes[i:i + 4096]).astype(np.float64)
        for g, v in sums.items():
            yield pd.DataFrame({"l": g, "d": np.arange(dim), "x": v})

    rows = train.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    grams = rows.mapInPandas(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    sums = stage(grams.mapInPandas(bundle, "l string, d int, x double").groupBy("l", "d").agg(F.sum("x").alias("x")),
                 "language_prototypes")
    if sums.count() * 8 > BROADCAST_BYTES:
        raise ValueError(f"{sums.count() // dim} languages: their prototypes exceed {BROADCAST_BYTES} bytes")
    v = sums.toPandas().sort_values(["l", "d"])
    langs = v["l"].iloc[::dim].tolist()
    protos = v["x"].to_numpy(dtype=np.float64).reshape(len(langs), dim)
    norm = np.linalg.norm(protos, axis=1, keepdims=True)
    return langs, protos / np.where(norm > 0, norm, 1.0)


def classify(texts: list[str | None], langs: list[str], protos: np.ndarray, dim: int = DIM,
             seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Language and cosine (cut at 0) of each text; ties go to the first language."""
    pred, score = [UND] * len(texts), np.zeros(len(texts))
    if not langs:
        return pred, score
    have: list[int] = []
    codes: list[np.ndarray] = []
    held = 0
    for i, t in enumerate(texts):
        c = trigrams(t)
        if c is not None:
            have.append(i)
            codes.append(c)
            held += len(c)
        if held and (held >= BATCH_GRAMS or i == len(texts) - 1):
            v = space(dim, seed).bundle(codes).astype(np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            cos = (v @ protos.T) / np.where(norm > 0, norm, 1.0)
            best = cos.argmax(axis=1)
            for k, b, x in zip(have, best, cos[np.arange(len(have)), best]):
                pred[k], score[k] = langs[b], min(1.0, max(0.0, float(x)))
            have, codes, held = [], [], 0
    return pred, score


def held_out(key: str):
    """crc32 of the id as text mod 3 is 1 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                dim: int = DIM, seed: int = SEED) -> DataFrame:
    """One row per input row: ``key``, held_out, lang_pred, score (cosine, 0 to 1).

    Learns from rows that are not held out and have a language (rows with a
    null key are not learnt from). Null texts and texts without a letter are
    ``und`` with score 0, and so is every text when there is nothing to learn
    from. Repeated rows are judged alike. Other columns are not read.
    """
    train = docs.where(F.col(key).isNotNull() & ~held_out(key))
    langs, protos = learn(train, text, lang, dim, seed)

    def run(frames):
        for f in frames:
            p, s = classify(f["t"].tolist(), langs, protos, dim, seed)
            yield pd.DataFrame({"id": f["id"], "z": f["z"], "held_out": f["h"], "lang_pred": p, "score": s})

    rows = docs.select(*ids(key), held_out(key).alias("h"), F.col(text).alias("t"))
    out = rows.mapInPandas(run, "id long, z boolean, held_out boolean, lang_pred string, score double")
    return out.select(back(key), "held_out", "lang_pred", "score")
