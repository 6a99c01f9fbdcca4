"""Helpers shared by the operators: stored stages, whole-group streaming,
size-checked broadcasts and connected components.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import apply_conf
from panelforge.sources.io import stage

# Runs of these characters separate words (fixed value of the contracts).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_CLEAR: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called where a task starts to fill a cache that its Python worker keeps:
    caches that other operators left in this worker are dropped, and their
    memory is handed back, so a worker holds one operator's cache at a time."""
    _CLEAR[name] = clear
    if _OWNER != [name]:
        for other, drop in _CLEAR.items():
            if other != name:
                drop()
        _OWNER[:] = [name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


BROADCAST_BYTES = 32 << 20  # bound of every explicit broadcast


def prepare(spark) -> None:
    """Session settings: UTC, and batches of whole texts that stay small in a
    Python worker (the default of 10,000 rows is meant for numbers)."""
    apply_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast when rows * row_bytes stays under
    BROADCAST_BYTES; beyond that it is left to a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup the batches of a partition sorted by ``key`` (never null) so that
    no run of equal keys is cut: each frame yielded holds whole groups."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        k = f[key].to_numpy()
        if held and held[-1][key].iloc[-1] == k[0] == k[-1]:
            held.append(f)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held or cut:
            done = pd.concat([*held, f.iloc[:cut]], ignore_index=True)
            if len(done):
                yield done
        held = [f.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               order: tuple[str, ...] = ()) -> DataFrame:
    """Deal rows by ``key``, sort, and give ``fn`` frames of many whole groups.

    Groups must be bounded by construction (cells, chunks, owners)."""
    def run(frames):
        for f in whole_groups(frames, key):
            out = fn(f)
            if out is not None and len(out):
                yield out
    return (df.repartition(F.col(key)).sortWithinPartitions(key, *order)
            .mapInPandas(run, schema))


def split_runs(key: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal neighbours."""
    if not len(key):
        return []
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    edges = np.concatenate([[0], cuts, [len(key)]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list with the smallest node of their component, by
    minimum labels and pointer jumping (no Python loop over edges)."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = idx[:len(a)], idx[len(a):]
    lab = np.arange(len(nodes))
    while len(i):
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], m)
        np.minimum.at(new, lab[j], m)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        new = new[lab]
        keep = new[i] != new[j]
        if np.array_equal(new, lab) and not keep.any():
            break
        lab, i, j = new, i[keep], j[keep]
    return nodes, nodes[lab]


EDGE_CHUNK = 1_000_000  # edges that one task contracts


def components(edges: DataFrame, name: str, chunk: int = EDGE_CHUNK, max_rounds: int = 50) -> DataFrame:
    """Connected components of (a long, b long): one row (node, component) per
    node that has an edge, component = smallest node reachable.

    Edges are dealt into chunks of at most ``chunk`` rows; each task replaces
    its chunk by the star forest of its components. With one chunk that is the
    answer; with more, large-star / small-star rounds join the forests until
    nothing changes. Every round is a stored stage; tables joined on a hub
    node are plain scans, so Spark can split a skewed hub.
    """
    def contract(frames):
        got = [f for f in frames if len(f)]
        if got:
            f = pd.concat(got, ignore_index=True)
            n, r = forest(f["u"].to_numpy(), f["v"].to_numpy())
            m = n != r
            yield pd.DataFrame({"u": n[m], "v": r[m]})

    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)
    n = -(-e.count() // chunk) or 1
    e = stage(e.repartition(n).mapInPandas(contract, "u long, v long"), name)
    if n > 1:
        mark = None
        for _ in range(max_rounds):
            up = stage(e.groupBy("u").agg(F.min("v").alias("m")), name).select(F.col("u").alias("w"), "m")
            e = stage(e.join(up, e["v"] == up["w"], "left")
                      .select("u", F.coalesce("m", "v").alias("v")).distinct(), name)
            up = stage(e.groupBy("u").agg(F.min("v").alias("m")), name).select(F.col("u").alias("w"), "m")
            both = e.join(up, e["u"] == up["w"])
            e = stage(both.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
                      .select("x.u", "x.v").where("u <> v").distinct(), name)
            now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError(f"{name}: components still change after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def ids(key: str) -> list:
    """``id`` (0 for null) and ``z`` (is null): pandas would turn a long column
    with nulls into doubles and lose digits of large ids."""
    k = F.col(key).cast("long")
    return [F.coalesce(k, F.lit(0).cast("long")).alias("id"), k.isNull().alias("z")]


def back(key: str):
    """The key column again from ``id`` and ``z``."""
    return F.when(~F.col("z"), F.col("id")).alias(key)


def text_hash(text: str):
    """64-bit hash of the raw text: with the key it names a row."""
    return F.xxhash64(F.col(text))


def pick_rows(docs: DataFrame, kept: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` (all columns) that ``kept`` names: stored rows (id, th,
    copies) with a null-safe id, the hash of the raw text, and how many rows of
    ``docs`` repeat that pair. Of repeated rows one is returned."""
    d = docs.withColumn("__th", text_hash(text))
    k = kept.select(F.col("id").alias("__id"), F.col("th").alias("__kth"), F.col("copies").alias("__c"))
    on = F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__kth"))
    once = k.where(F.col("__c") == 1)
    out = d.join(small_side(once, 32), on, "left_semi")
    more = k.where(F.col("__c") > 1)
    if not more.isEmpty():
        out = out.unionByName(d.join(small_side(more, 32), on, "left_semi").dropDuplicates([key, "__th"]))
    return out.drop("__th")
