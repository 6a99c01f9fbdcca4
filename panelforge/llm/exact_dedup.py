"""Exact dedup by exchange of Golomb-coded fingerprints.

1. One scan normalises each text and stores a narrow table: row id, sender
   (the scan partition), 64-bit fingerprint, SHA-256.
2. Each sender sorts its distinct fingerprints and sends every owner (a range
   of the fingerprint space) its part as one Golomb-Rice coded list. The
   fingerprint is cut to log2(rows) + SPARE bits, so an entry costs about
   SPARE + 1.5 bits.
3. Owners decode their lists and answer each list with a bitmap: which of its
   entries another sender has too.
4. Senders turn bitmaps (and their own repeats) into suspects. Only the texts
   of suspects are shuffled, grouped by their bytes, which confirms or clears
   them. Rows that are no suspects are alone by construction: equal texts have
   equal fingerprints.

No group of copies meets in one task: a sender sends a fingerprint once, and
the verification is an aggregate with partial sums on the map side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, back, ids, map_groups, small_side, split_runs, text_hash
from panelforge.sources.io import stage

SPARE = 12            # fingerprint bits beyond log2(rows): 2**-12 false suspects
OWNER_ROWS = 250_000  # fingerprints per owner


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct non-negative integers -> (k, bytes): gaps as a unary
    quotient stream followed by k-bit remainders."""
    v = values.astype(np.uint64)
    gap = np.diff(v, prepend=np.uint64(0))
    mean = float(v[-1]) / len(v) if len(v) else 0.0
    k = max(0, int(np.floor(np.log2(mean * 0.69))) if mean >= 2 else 0)
    q = (gap >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1                       # position of each terminating 1
    unary = np.zeros(int(ends[-1]) + 1 if len(v) else 0, dtype=np.uint8)
    unary[ends] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gap[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    """Inverse of golomb_encode."""
    bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(bits)[:n]
    q = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1: ends[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    weights = np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)
    gap = (q.astype(np.uint64) << np.uint64(k)) + (rest * weights).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gap, dtype=np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored narrow table: uid, id, th (hash of the raw text), src, fp (64 bits),
    sha (of the normalised text)."""
    norm = normalised(text)
    return stage(docs.select(F.col(key).cast("long").alias("id"), text_hash(text).alias("th"), norm.alias("norm"))
                 .select(F.monotonically_increasing_id().alias("uid"), "id", "th",
                         F.spark_partition_id().cast("long").alias("src"),
                         F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")),
                 "exact_fp")


def normalised(text: str = "text"):
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _codes(fp: np.ndarray, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code within the owner of each fingerprint, cut to ``bits``."""
    top = fp.view(np.uint64) >> np.uint64(64 - bits)
    width = np.uint64(-(-(1 << bits) // owners))
    return (top // width).astype(np.int64), top % width


def suspects(fp: DataFrame) -> DataFrame:
    """Stored rows of ``fp`` whose fingerprint some other row has too."""
    rows = fp.count()
    bits = min(63, max(20, int(np.ceil(np.log2(rows + 1))) + SPARE))
    owners = max(16, -(-rows // OWNER_ROWS))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in split_runs(pdf["src"].to_numpy()):
            own, code = _codes(pdf["fp"].to_numpy()[a:b], bits, owners)
            order = np.lexsort((code, own))
            own, code = own[order], code[order]
            for s, e in split_runs(own):
                u = np.unique(code[s:e])
                k, blob = golomb_encode(u)
                out.append((int(own[s]), int(pdf["src"].iloc[a]), len(u), k, blob))
        return pd.DataFrame(out, columns=["owner", "src", "n", "k", "blob"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in split_runs(pdf["owner"].to_numpy()):
            part = pdf.iloc[a:b]
            lists = [golomb_decode(x, n, k) for x, n, k in zip(part["blob"], part["n"], part["k"])]
            allv = np.concatenate(lists)
            v, c = np.unique(allv, return_counts=True)
            twice = v[c > 1]
            for src, li in zip(part["src"], lists):
                out.append((int(src), int(part["owner"].iloc[0]), len(li),
                            np.packbits(np.isin(li, twice, assume_unique=True)).tobytes()))
        return pd.DataFrame(out, columns=["src", "owner", "n", "bitmap"])

    def mark(pdf: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        own, code = _codes(pdf["fp"].to_numpy(), bits, owners)
        order = np.lexsort((code, own))
        o, c = own[order], code[order]
        first = np.ones(len(o), dtype=bool)
        first[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
        slot = np.cumsum(first) - 1                  # rank among the sender's distinct entries
        maps = maps.sort_values("owner")
        hit = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n)
                              for b, n in zip(maps["bitmap"], maps["n"])]).astype(bool)
        again = np.bincount(slot) > 1                # repeats within the sender
        bad = np.zeros(len(o), dtype=bool)
        bad[order] = (hit | again)[slot]
        return pdf.loc[bad, ["uid", "id", "z", "sha"]]

    sent = map_groups(fp.select("src", "fp"), "src", send, "owner long, src long, n int, k int, blob binary")
    maps = stage(map_groups(sent, "owner", answer, "src long, owner long, n int, bitmap binary"), "exact_maps")
    rows = fp.select("uid", *ids("id"), "src", "fp", "sha")
    return stage(rows.groupBy("src").cogroup(maps.groupBy("src"))
                 .applyInPandas(mark, "uid long, id long, z boolean, sha binary")
                 .select("uid", back("id"), "sha"), "exact_suspects")


def verified_classes(docs: DataFrame, sus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored classes (sha, keep_id, keep_uid, group_size) of suspects whose
    texts are equal byte by byte; a SHA-256 shared by different texts raises."""
    those = stage(sus.select(F.col("id").alias("sid")).distinct(), "exact_ids")
    rows = docs.select(F.col(key).cast("long").alias("id"), text)
    rows = rows.join(small_side(those, 16), F.col("id").eqNullSafe(F.col("sid")), "left_semi")
    texts = rows.groupBy(normalised(text).alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    texts = (texts.groupBy(F.unhex(F.sha2("norm", 256)).alias("vsha"))
             .agg(F.count(F.lit(1)).alias("variants")))
    cls = (sus.groupBy("sha")
           .agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "uid")).alias("k"),
                F.count(F.lit(1)).alias("group_size")))
    checked = F.when(F.col("variants") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("texts of one SHA-256 differ or are missing")).cast("long"))
    return stage(cls.join(texts, cls["sha"] == texts["vsha"], "left")
                 .select(F.col("sha").alias("csha"), F.col("k.id").alias("keep_id"),
                         F.col("k.uid").alias("keep_uid"), checked.alias("group_size")), "exact_classes")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space.
    Null texts count as empty, empty texts are copies of each other. The row
    with the smallest key stays (null keys last; of rows that repeat the same
    key and text exactly one has kept = true). An empty table gives an empty
    result. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    fp = fingerprints(docs, key, text)
    sus = suspects(fp)
    cls = verified_classes(docs, sus, key, text)
    copies = sus.join(cls, sus["sha"] == cls["csha"]).select(
        "uid", "id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "sha")
    # the suspects are a subset of fp: rows without one stay alone
    alone = fp.join(sus.select(F.col("uid").alias("su")), F.col("uid") == F.col("su"), "left_anti").select(
        "uid", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    return copies.unionByName(alone).select(
        F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
