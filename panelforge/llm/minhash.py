"""Near-dedup by b-bit MinHash.

1. Sketch (one scan): a document's set is its distinct shingles of WORDS words
   as 64-bit hashes. HASHES minima are taken; bands of ROWS full minima become
   bucket keys, and only the low BITS bits of every minimum are kept, packed
   into 48 bytes. Documents with equal sets are one class from here on.
2. Candidates: classes that share a bucket are compared by counting equal
   b-bit values: with m of k equal, J is estimated as
   (m / k - 2**-b) / (1 - 2**-b), which takes out chance collisions. Buckets of
   any size are cut into cells of bounded size (chunk against chunk), and a
   task sends on the star forest of its close pairs, not the pairs.
3. Confirmation: candidates that hang together form a block; members bring
   their full sets, again in bounded cells, and a pair is linked when its sets
   say so. A pair whose ends are already linked is not counted again, so a
   group of n copies costs about n links; no candidate is dropped otherwise.
4. Components of the links, and every document gets its class's component.

At similarity 0.85 a pair shares none of BANDS buckets with probability
(1 - 0.85**6)**32 = 3e-7; the estimate's standard deviation there is 0.03, and
pairs are kept down to SURE = 0.66. At 0.80, which the pipeline takes, that is
6e-5, and SURE lies four deviations below.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import back, claim, components, forest, ids, map_groups, small_side, split_runs, text_hash
from panelforge.sources.io import stage

WORDS = 5
PERCENT = 85
BANDS, ROWS, BITS = 32, 6, 2
HASHES = BANDS * ROWS
SURE = 0.66
BUCKET_CHUNK = 1024    # classes of a bucket that meet in one cell, per side
SET_CHUNK = 256        # full sets that meet in one cell, per side
WORDS_KEPT = 150_000

_RNG = np.random.default_rng(9)
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_WORD: dict[bytes, int] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (A-Z lower-cased,
    words split at white space; fewer than WORDS words: one of them all)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    claim("minhash", _WORD.clear)
    if len(_WORD) >= WORDS_KEPT:
        _WORD.clear()
    h = list(map(_WORD.get, words))
    if None in h:
        for i, x in enumerate(h):
            if x is None:
                h[i] = _WORD[words[i]] = xxhash.xxh64_intdigest(words[i])
    h = np.array(h, dtype=np.uint64)
    n = min(len(h), WORDS)
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s += h[i:len(h) - n + 1 + i] * _PLACE[i]
    return np.unique(mix64(s))


def minima(shingle: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima of a non-empty set."""
    x = (shingle ^ (shingle >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        v = (x[None, i:i + 1024] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def packed(m: np.ndarray) -> bytes:
    """Low BITS bits of each minimum, packed."""
    bits = (m[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def bands(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((rows * _BAND).sum(axis=1, dtype=np.uint64) ^ _SEED).view(np.int64)


def matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint64).reshape(len(sigs), -1)


_LOW = np.uint64(0x5555555555555555)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate from packed signatures (last axis: words)."""
    x = a ^ b
    same = np.bitwise_count(~(x | (x >> np.uint64(1))) & _LOW).sum(axis=-1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return (same / HASHES - chance) / (1 - chance)


def linked(inter: int, na: int, nb: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (na + nb - inter)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored: uid, id, th (hash of the raw text), n, set_key, sig, bands."""
    def run(frames):
        for f in frames:
            out = []
            for i, z, th, t in zip(f["id"].tolist(), f["z"].tolist(), f["th"].tolist(), f["t"]):
                s = shingles(t)
                if len(s):
                    m = minima(s)
                    out.append((i, z, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), packed(m), bands(m)))
                else:
                    out.append((i, z, th, 0, None, None, None))
            yield pd.DataFrame(out, columns=["id", "z", "th", "n", "set_key", "sig", "bands"])

    rows = docs.select(*ids(key), text_hash(text).alias("th"), F.col(text).alias("t"))
    s = rows.mapInPandas(run, "id long, z boolean, th long, n long, set_key binary, sig binary, bands array<long>")
    return stage(s.select(F.monotonically_increasing_id().alias("uid"), back("id"), "th", "n",
                          "set_key", "sig", "bands"), "near_sketch")


def cells(members: DataFrame, group: str, size: str, chunk: int) -> DataFrame:
    """Deal each group's members (node) into chunks and chunk pairs: adds
    ``part``, ``alone`` (a cell of one chunk) and ``cell``. A group of at most
    ``chunk`` members is one cell; else every pair of chunks is one."""
    c = F.ceil(F.col(size) / chunk).cast("int")
    m = (members.withColumn("__c", c)
         .withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("__c")).cast("int"))
         .withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__c") - 1))))
    lo, hi = F.least("part", "__q"), F.greatest("part", "__q")
    return (m.withColumn("alone", F.col("part") == F.col("__q"))
            .withColumn("cell", F.xxhash64(group, lo, hi)).drop("__c", "__q"))


def close_forest(f: pd.DataFrame, percent: int) -> pd.DataFrame | None:
    """Star forest of the pairs in each cell that look similar enough."""
    cell, node = f["cell"].to_numpy(), f["node"].to_numpy()
    n, sig = f["n"].to_numpy(), matrix(f["sig"])
    part, alone = f["part"].to_numpy(), f["alone"].to_numpy()
    a, b = [], []

    def keep(i, j):
        ok = (alone[i] | (part[i] != part[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        ok = similarity(sig[i], sig[j]) >= SURE
        a.append(node[i[ok]])
        b.append(node[j[ok]])

    runs = split_runs(cell)
    for d in range(1, 32):           # small cells: all rows d apart at once
        i = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(i):
            break
        keep(i, i + d)
    for s, e in runs:
        if e - s <= 32:
            continue
        for i in range(s, e):        # large cells: one row against the rest
            if i + 32 < e:
                j = np.arange(i + 32, e)
                keep(np.full(len(j), i), j)
    u, r = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))
    m = u != r
    return pd.DataFrame({"a": u[m], "b": r[m]}) if m.any() else None


def links_of(node: np.ndarray, part: np.ndarray, alone: np.ndarray, sets: list[np.ndarray],
             sig: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of one cell that a spanning forest needs, on full sets."""
    n = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(node), 1)
    ok = ((alone[i] | (part[i] != part[j])) & (node[i] != node[j])
          & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])))
    i, j = i[ok], j[ok]
    est = similarity(sig[i], sig[j])
    ok = est >= SURE
    i, j = i[ok], j[ok]
    order = np.argsort(-est[ok], kind="stable")
    root = list(range(len(node)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    as_set: dict[int, frozenset] = {}

    def members(x):
        if x not in as_set:
            as_set[x] = frozenset(sets[x].tolist())
        return as_set[x]

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        rx, ry = find(x), find(y)
        if rx != ry and linked(len(members(x) & members(y)), int(n[x]), int(n[y]), percent):
            root[max(rx, ry)] = min(rx, ry)
            out.append((int(node[x]), int(node[y])))
    return out


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    bucket_chunk: int = BUCKET_CHUNK, set_chunk: int = SET_CHUNK) -> DataFrame:
    """Stored, one row per input row: uid, id, th, n, comp (component number),
    component_id (smallest id in it)."""
    s = sketch(docs, key, text)
    cls = stage(s.where("n > 0").groupBy("set_key")
                .agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th")).alias("k"),
                     F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
                .select(F.monotonically_increasing_id().alias("node"), "set_key", "k.id", "k.th", "n", "sig", "bands"),
                "near_classes")

    hits = cls.select("node", F.explode("bands").alias("h"))
    shared = stage(hits.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
                   .select(F.col("h").alias("hh"), "size"), "near_buckets")
    inside = stage(hits.join(shared, F.col("h") == F.col("hh")).select("node", "h", "size"), "near_members")
    sig = cls.select(F.col("node").alias("cn"), "n", "sig")
    inside = inside.join(sig, F.col("node") == F.col("cn")).select("node", "h", "size", "n", "sig")
    close = map_groups(cells(inside, "h", "size", bucket_chunk).select("cell", "node", "part", "alone", "n", "sig"),
                       "cell", lambda f: close_forest(f, percent), "a long, b long")
    blocks = stage(components(close, "near_close"), "near_blocks")

    sizes = stage(blocks.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
                  .select(F.col("component").alias("block"), "size"), "near_sizes")
    members = (blocks.join(sizes, F.col("component") == F.col("block")).select("node", "block", "size"))
    members = stage(members.join(cls.select(F.col("node").alias("cn"), "set_key", "id", "th", "sig"),
                                 F.col("node") == F.col("cn"))
                    .select("node", "block", "size", "set_key", F.col("id").alias("mid"), F.col("th").alias("mth"),
                            "sig"), "near_members")

    def sets(frames):
        for f in frames:
            got = [shingles(t) for t in f["t"]]
            same = [xxhash.xxh3_128_digest(g.tobytes()) == bytes(k) for g, k in zip(got, f["set_key"])]
            out = f[["node", "block", "size", "sig"]].assign(shingles=[g.tobytes() for g in got])
            yield out[np.array(same, dtype=bool)]

    texts = docs.select(F.col(key).cast("long").alias("id"), text_hash(text).alias("th"), F.col(text).alias("t"))
    full = (texts.join(small_side(members, 160),
                       F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")))
            .select("node", "block", "size", "set_key", "sig", "t")
            .mapInPandas(sets, "node long, block long, size long, sig binary, shingles binary"))

    def confirm(f: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for a, b in split_runs(f["cell"].to_numpy()):
            p = f.iloc[a:b].drop_duplicates("node")
            if len(p) > 1:
                out += links_of(p["node"].to_numpy(), p["part"].to_numpy(), p["alone"].to_numpy(),
                                [np.frombuffer(x, dtype=np.uint64) for x in p["shingles"]], matrix(p["sig"]), percent)
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    found = map_groups(cells(full, "block", "size", set_chunk)
                       .select("cell", "node", "part", "alone", "sig", "shingles"),
                       "cell", confirm, "a long, b long")
    comp = components(found, "near_links")

    named = stage(cls.select("node", "set_key", "id").join(
        comp.select(F.col("node").alias("cn"), "component"), F.col("node") == F.col("cn"), "left")
        .select("set_key", "id", F.coalesce("component", "node").alias("comp")), "near_named")
    low = stage(named.groupBy("comp").agg(F.min("id").alias("component_id"))
                .select(F.col("comp").alias("lc"), "component_id"), "near_low")
    named = stage(named.join(low, F.col("comp") == F.col("lc"))
                  .select(F.col("set_key").alias("k"), "comp", "component_id"), "near_names")
    out = s.select("uid", "id", "th", "n", "set_key").where("n > 0").join(named, F.col("set_key") == F.col("k"))
    return (out.select("uid", "id", "th", "n", "comp", "component_id")
            .unionByName(s.where("n = 0").select("uid", "id", "th", "n", (-F.col("uid") - 1).alias("comp"),
                                                 F.col("id").alias("component_id"))))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``key``, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of
    their shingle sets; component_id is the smallest key reachable by links.
    Null, empty and blank texts have the empty set and are linked with
    nothing. kept is key = component_id, so rows that repeat a kept key and
    text are all marked (``pick_rows`` takes one of them); a row with a null
    key is never kept unless its whole component has none (then kept is
    false too and component_id null). Other columns are not read.
    """
    return near_components(docs, key, text, percent).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
