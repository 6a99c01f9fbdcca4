"""Toxicity by class-conditional Kneser-Ney models.

Two word models, one of toxic and one of ordinary training documents. Their
counts are Kneser-Ney continuation counts: in how many different left contexts
a word occurs, so a passage copied a thousand times counts once. Both models
discount and back off to one shared continuation distribution:

    p_c(w) = max(N_c(w) - D_c, 0) / N_c + lambda_c * p_shared(w)

with D_c in proportion to the class's mass: a rare expression stays with the
shared counts until its class has seen it in more than D_c contexts, and its
log-likelihood ratio is that of the two lambdas. D grows with the logarithm of
the contexts seen, as the largest chance excess among rare words does.

Counts are a Spark table of one row per word, by its 64-bit hash; it grows with
the vocabulary. Words that neither class has seen in more than D_c contexts all
have one ratio, log(lambda_1 / lambda_0), so the table that texts are scored
with holds the other words only, and nothing is lost. It is sent to the tasks
while it is at most ``near_bytes``; beyond that the distinct words of each text
are joined with it by a shuffle, with the same results.

A text gets two statistics. ``mean`` compares the length-normalised
log-likelihoods: the mean ratio of its words less the background (the median
ratio of the training contexts). ``excess``: the topic or language of a document
shifts all its words alike, so ratios are taken from the document's median, but
never from above the background (a text of mostly toxic words is not measured by
itself); what exceeds that by more than SLACK nats is summed and divided by the
square root of the length. A logistic curve over both, fitted on training rows
kept from the counts, turns them into a probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, back, claim, ids, map_groups, small_side, split_runs
from panelforge.sources.io import stage

SLACK = 1.5            # nats above the centre that count
WORDS_KEPT = 400_000
MARKS = ".,;:!?\"'()[]{}<>*#$%&|~`"
BINS = 2000            # of the calibration histogram: excess
MEAN_BINS = 100        # and mean
TOP = 20.0             # largest excess of the histogram
MEAN_TOP = 5.0         # largest mean, on both sides
ROW_BYTES = 16         # a word's hash and its ratio


class Words:
    """Text -> 64-bit word hashes (0: none), through a bounded cache."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _id(self, w: str) -> int:
        bare = w.lower().strip(MARKS)
        if not bare:
            return 0
        h = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), seed=7)
        return h - (1 << 64) if h >> 63 else h

    def text(self, text: str | None) -> np.ndarray:
        claim("toxicity", self.known.clear)
        words = (text or "").split()
        known = self.known
        try:
            out = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) >= WORDS_KEPT:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._id(w)
            out = list(map(known.__getitem__, words))
        a = np.array(out, dtype=np.int64)
        return a[a != 0]


_WORDS = Words()


def contexts(words: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each word's left word (of nothing for the first)."""
    left = np.concatenate([[1], words[:-1]]).astype(np.int64).view(np.uint64)
    return ((left * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def distinct_contexts(w: np.ndarray, left: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """The distinct (w, left, y), found by a 64-bit mix of the three."""
    m = (w.view(np.uint64) ^ (left.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
    at = np.unique(m + y.astype(np.uint64), return_index=True)[1]
    return pd.DataFrame({"w": w[at], "l": left[at], "y": y[at]})


def statistics(x: np.ndarray, n: np.ndarray, background: float) -> tuple[float, float]:
    """(mean, excess) of a text whose words have the ratios ``x``, ``n`` times
    each. The median is the lower one of an even number."""
    size = int(n.sum())
    if not size:
        return 0.0, 0.0
    order = np.argsort(x, kind="stable")
    median = float(x[order][np.searchsorted(np.cumsum(n[order]), (size + 1) // 2)])
    over = x - min(median, background) - SLACK
    up = over > 0
    return float(x @ n) / size - background, float(over[up] @ n[up]) / math.sqrt(size)


class Model:
    """``table``: stored rows (w, r), the words whose ratio is not ``default``;
    ``background``; ``curve``: weights of mean, excess and one."""

    def __init__(self, table: DataFrame | None, default: float, background: float, near_bytes: int):
        self.table, self.default, self.background, self.near_bytes = table, default, background, near_bytes
        self.curve = np.zeros(3)

    def measure(self, rows: DataFrame, schema: str) -> DataFrame:
        """``rows`` (t text and the columns of ``schema``) -> those columns, mean, excess."""
        if self.table is None:
            return rows.select(*_names(schema), F.lit(0.0).alias("mean"), F.lit(0.0).alias("excess"))
        if self.table.count() * ROW_BYTES <= self.near_bytes:
            return self._near(rows, schema)
        return self._far(rows, schema)

    def _near(self, rows: DataFrame, schema: str) -> DataFrame:
        got = self.table.orderBy("w").toPandas()
        sent = rows.sparkSession.sparkContext.broadcast((got["w"].to_numpy(dtype=np.int64),
                                                         got["r"].to_numpy(dtype=np.float64)))
        default, background, names = self.default, self.background, _names(schema)

        def run(frames):
            w, r = sent.value
            for f in frames:
                out = np.zeros((len(f), 2))
                for i, t in enumerate(f["t"]):
                    a, n = np.unique(_WORDS.text(t), return_counts=True)
                    x = np.full(len(a), default)
                    if len(w):
                        at = np.minimum(np.searchsorted(w, a), len(w) - 1)
                        hit = w[at] == a
                        x[hit] = r[at[hit]]
                    out[i] = statistics(x, n, background)
                yield pd.DataFrame({**{c: f[c] for c in names}, "mean": out[:, 0], "excess": out[:, 1]})

        return rows.select(*names, "t").mapInPandas(run, f"{schema}, mean double, excess double")

    def _far(self, rows: DataFrame, schema: str) -> DataFrame:
        """One row per distinct word of each distinct text, joined with the table."""
        default, background, names = self.default, self.background, _names(schema)
        a, b = F.xxhash64("t"), F.xxhash64("t", F.lit(3))

        def explode(frames):
            for f in frames:
                parts = []
                held = 0
                for ta, tb, t in zip(f["ta"], f["tb"], f["t"]):
                    w, n = np.unique(_WORDS.text(t), return_counts=True)
                    parts.append(pd.DataFrame({"ta": ta, "tb": tb, "w": w, "n": n}))
                    held += len(w)
                    if held > 200_000:
                        yield pd.concat(parts, ignore_index=True)
                        parts, held = [], 0
                if parts:
                    yield pd.concat(parts, ignore_index=True)

        def texts(f: pd.DataFrame) -> pd.DataFrame:
            ta, tb = f["ta"].to_numpy(), f["tb"].to_numpy()
            r, n = f["r"].to_numpy(dtype=np.float64), f["n"].to_numpy(dtype=np.int64)
            out = []
            for i, j in split_runs(ta):
                for k in np.unique(tb[i:j]):
                    m = tb[i:j] == k
                    out.append((ta[i], k, *statistics(r[i:j][m], n[i:j][m], background)))
            return pd.DataFrame(out, columns=["xa", "xb", "mean", "excess"])

        once = rows.select(a.alias("ta"), b.alias("tb"), "t").dropDuplicates(["ta", "tb"])
        words = once.mapInPandas(explode, "ta long, tb long, w long, n long")
        table = self.table.withColumnRenamed("w", "tw")
        rated = words.join(table, F.col("w") == F.col("tw"), "left").select(
            "ta", "tb", "w", "n", F.coalesce("r", F.lit(default)).alias("r"))
        per = map_groups(rated, "ta", texts, "xa long, xb long, mean double, excess double", order=("w",))
        return rows.withColumn("__a", a).withColumn("__b", b).join(
            per, (F.col("__a") == F.col("xa")) & (F.col("__b") == F.col("xb")), "left").select(
            *names, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("excess", F.lit(0.0)).alias("excess"))

    def score(self):
        """The probability as a column, from mean and excess."""
        a, b, c = (float(v) for v in self.curve)
        z = F.lit(a) * F.col("mean") + F.lit(b) * F.col("excess") + F.lit(c)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of ``x`` and of a constant: a logistic fit to
    counts (Newton)."""
    x = x if x.ndim == 2 else x[:, None]
    if not pos.sum() or not neg.sum():
        rate = (pos.sum() + 0.5) / (pos.sum() + neg.sum() + 1.0)
        return np.concatenate([np.zeros(x.shape[1]), [np.log(rate / (1 - rate))]])
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    n = pos + neg
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (pos - n * p) - ridge * w
        h = (z * (n * p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() or 1.0))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(key: str):
    """crc32 of the id as text mod 4 is 2 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ratios(counts: DataFrame, discount: float | None = None, near_bytes: int = BROADCAST_BYTES) -> Model:
    """Model of stored counts (w, n0, n1): contexts of each word in either class."""
    t0, t1, v = counts.agg(F.sum("n0"), F.sum("n1"), F.count(F.lit(1))).first()
    if not t0 or not t1:
        return Model(None, 0.0, 0.0, near_bytes)
    least = min(t0, t1)
    if discount is None:
        discount = max(0.75, math.log10(least) - 1.5)
    d = [discount * t0 / least, discount * t1 / least]
    cut = counts.agg(*[F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(d[c]))) for c in (0, 1)]).first()
    lam = [cut[0] / t0, cut[1] / t1]
    mass = t0 + t1 + 0.5 * (v + 1)               # half a context for each word and for all unseen ones
    shared = (F.col("n0") + F.col("n1") + 0.5) / F.lit(mass)
    p = [F.greatest(F.col(f"n{c}") - F.lit(d[c]), F.lit(0.0)) / F.lit(float(t)) + F.lit(lam[c]) * shared
         for c, t in ((0, t0), (1, t1))]
    rated = counts.select("w", (F.col("n0") + F.col("n1")).alias("n"), F.log(p[1] / p[0]).alias("r"),
                          ((F.col("n0") > d[0]) | (F.col("n1") > d[1])).alias("own"))
    default = math.log(lam[1] / lam[0])
    # weighted median to a thousandth of a nat: the histogram is bounded by the range of a logarithm
    hist = (rated.groupBy(F.round("r", 3).alias("r")).agg(F.sum("n").alias("n")).orderBy("r").toPandas())
    at = np.searchsorted(np.cumsum(hist["n"].to_numpy()), (t0 + t1) / 2)
    table = stage(rated.where("own").select("w", "r"), "toxic_ratios")
    return Model(table, default, float(hist["r"].iloc[at]), near_bytes)


def learn(train: DataFrame, discount: float | None = None, near_bytes: int = BROADCAST_BYTES) -> Model:
    """Fit on stored rows (t text, y 0/1, cal boolean): counts from rows with
    cal false, the curve from those with cal true."""
    def seen(frames):
        parts, held = [], 0
        for f in frames:
            for t, y in zip(f["t"], f["y"]):
                w = _WORDS.text(t)
                if len(w):
                    parts.append((w, contexts(w), np.full(len(w), y, dtype=np.int8)))
                    held += len(w)
                if held > 2_000_000:               # bounded memory: distinct so far
                    yield distinct_contexts(*map(np.concatenate, zip(*parts)))
                    parts, held = [], 0
        if parts:
            yield distinct_contexts(*map(np.concatenate, zip(*parts)))

    fit = train.where("NOT cal").select("t", "y")
    keys = fit.mapInPandas(seen, "w long, l int, y byte").distinct()
    counts = stage(keys.groupBy("w").agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("n0"),
                                         F.sum(F.col("y").cast("long")).alias("n1")), "toxic_counts")
    model = ratios(counts, discount, near_bytes)

    bins = (F.least(F.floor(F.col("excess") / TOP * BINS), F.lit(BINS - 1)).alias("e"),
            F.greatest(F.lit(0), F.least(F.floor((F.col("mean") + MEAN_TOP) / (2 * MEAN_TOP) * MEAN_BINS),
                                         F.lit(MEAN_BINS - 1))).alias("m"))
    hist = (model.measure(train.where("cal"), "y int").groupBy(*bins)
            .agg(F.sum(F.col("y").cast("double")).alias("pos"), F.sum(1.0 - F.col("y")).alias("neg"))
            .orderBy("e", "m").toPandas())
    x = np.column_stack([(hist["m"] + 0.5) * 2 * MEAN_TOP / MEAN_BINS - MEAN_TOP, (hist["e"] + 0.5) * TOP / BINS])
    model.curve = logistic(x, hist["pos"].to_numpy(dtype=float), hist["neg"].to_numpy(dtype=float))
    return model


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Stored training rows: text, label, and whether a row is for the curve
    (a fifth of them, by a hash of the id). A key that has both labels is toxic."""
    lab = stage(labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
                .groupBy(F.col(key).cast("long").alias("lid"))
                .agg(F.max((F.col(label) > 0).cast("int")).alias("y")), "toxic_labels")
    rows = (docs.where(F.col(key).isNotNull() & ~held_out(key))
            .select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    cal = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) == 0
    return rows.join(small_side(lab, 24), F.col("id") == F.col("lid")).select("t", "y", cal.alias("cal"))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "toxic", cut: float = 0.3, discount: float | None = None,
             near_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: ``key``, held_out, score (0 to 1), predicted
    (score >= ``cut``), mean and excess (the two statistics).

    Labels are read only for rows that are not held out; neither labels nor any
    column but the text is an input of a score. Null and empty texts have
    statistics 0; repeated rows are scored alike. Without labels of one class
    every text gets that rate. An empty table gives an empty result.
    """
    model = learn(labelled(docs, labels, key, text, label), discount, near_bytes)
    rows = docs.select(*ids(key), held_out(key).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = model.measure(rows, "id long, z boolean, held_out boolean").withColumn("score", model.score())
    return out.select(back(key), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"),
                      "mean", "excess")
