"""Embedding near-dedup by NN-descent.

Within a label (and length), every distinct vector keeps a list of its nearest
neighbours. The lists start from seeded sign codes: vectors are sorted by the
signs of random projections, several times, and each run of WINDOW neighbours
in that order is compared. Then lists are refined: the members of a vector's
list and of the lists it is in meet in groups of bounded size, all pairs of a
group are compared, and better neighbours replace worse ones. A list whose
entries all reach the threshold is saturated and doubles, up to LIST_MAX.

Every pair that a round computes at or above the threshold is kept as an edge
(a task sends the star forest of its edges, never all pairs). Components of
the edges are then counted exactly: members meet chunk against chunk, and each
gets the number of vectors linked to it, also in components far larger than
any list. Rounds end when no list finds another link
and no saturated list can still grow. The recall audit compares a bounded
sample of vectors with all vectors of their label; while a sampled vector
misses a link, another set of sign codes and another descent add edges.

A sample cannot show that nothing is missing, and one missing link splits a
component. So the links between components are then searched exactly: the
vectors of a label are cut into chunks (a component's members together, the
others in the order of their codes) with a centre and a radius, and two chunks
are compared when their centres are no further apart than both radii and the
threshold's angle (angles obey the triangle inequality) and they are not of one
component. Dense components are left out by their small radius; vectors spread
over all directions are not, so their part of the search grows with the square
of a label's unlinked vectors, spread over tasks of two chunks each.

Exact copies are one vector throughout (they count as links of each other).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import components, forest, map_groups, small_side, split_runs
from panelforge.llm.minhash import cells
from panelforge.sources.io import stage

COSINE = 0.98
LIST, LIST_MAX = 8, 32
START_KEEP = 4          # neighbours a vector keeps from one run of the sorted order
WINDOW = 64             # vectors compared at once
CODE_BITS = 48
ROUNDS = 6
COUNT_CHUNK = 512       # component members that meet in one cell, per side
AUDIT_ROWS = 256        # vectors of the recall audit (a bounded sample)
AUDITS = 2
CHUNK = 512             # vectors of a chunk of the exact search
TIGHT = 64              # members of a component that make chunks of their own
CENTRES = 1024          # chunk centres that meet in one cell, per side
SLACK = 1e-6            # radians added to a bound, for rounding


def unit(vectors) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)       # squares of large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(embedding: str, label: str):
    """No null, NaN or infinite component, not all zero, and a label."""
    v = F.col(embedding)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Stored: node, block (of label and length), v, id (smallest), copies."""
    c = (rows.where("ok").groupBy("label", "v")
         .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    return stage(c.select(F.monotonically_increasing_id().alias("node"),
                          F.xxhash64("label", F.size("v")).alias("block"), "v", "id", "copies"), "nn_vectors")


def kind(vectors: DataFrame) -> str:
    return vectors.schema["v"].dataType.simpleString()


def planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, CODE_BITS))


def codes(vectors, seeds: list[int]) -> np.ndarray:
    """One CODE_BITS-bit sign code per vector and seed."""
    out = np.zeros((len(vectors), len(seeds)), dtype=np.int64)
    weights = 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
    size = np.array([len(v) for v in vectors])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = unit([vectors[i] for i in at])
        for j, seed in enumerate(seeds):
            out[at, j] = (x @ planes(int(d), seed) > 0) @ weights
    return out


def tables_needed(largest: int) -> int:
    """Sorted orders that miss a pair at the threshold with less than 1e-4:
    a run of WINDOW out of n shares about log2(n / WINDOW) leading signs."""
    flip = math.acos(COSINE) / math.pi
    share = 0.6 * (1 - flip) ** max(0.0, math.log2(max(1, largest) / WINDOW))
    return max(4, math.ceil(math.log(1e-4) / math.log(1 - share)))


def best_pairs(node: np.ndarray, x: np.ndarray, keep: int, threshold: float, worst=None, known=None):
    """Of all pairs in one group: each member's best ``keep`` (better than its
    worst entry and not in its list), and the pairs at the threshold."""
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    s[node[:, None] == node[None, :]] = -2.0
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    if worst is not None:
        s = np.where(s > worst[:, None], s, -2.0)
        for r, k in enumerate(known):
            if len(k):
                s[r, np.isin(node, k)] = -2.0
    k = min(keep, len(node) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(node), 0), dtype=int)
    r = np.repeat(np.arange(len(node)), top.shape[1])
    c = top.ravel()
    ok = s[r, c] > -1.5
    r, c = r[ok], c[ok]
    # a neighbour at the threshold for a list that still has entries below it
    fresh = (s[r, c] >= threshold) & (worst[r] < threshold if worst is not None else True)
    return (node[r], node[c], s[r, c], fresh), (node[i], node[j])


PAIRS = "a long, b long, s double, edge boolean, fresh boolean"


def pair_frame(found, edges, threshold: float) -> pd.DataFrame:
    """Neighbour candidates, and the star forest of the edges."""
    a, b, s, fresh = (np.concatenate(z) for z in zip(*found)) if found else ([], [], [], [])
    out = pd.DataFrame({"a": a, "b": b, "s": s, "edge": False, "fresh": fresh})
    if edges:
        n, r = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        m = n != r
        out = pd.concat([out, pd.DataFrame({"a": n[m], "b": r[m], "s": threshold, "edge": True, "fresh": False})])
    return out.astype({"a": "int64", "b": "int64", "s": "float64", "edge": "bool", "fresh": "bool"})


def start(vectors: DataFrame, seeds: list[int], threshold: float) -> DataFrame:
    """Pairs found in runs of the sign-code orders."""
    def code(frames):
        for f in frames:
            k = codes(f["v"].tolist(), seeds)
            yield pd.concat([f.assign(o=j, code=k[:, j]) for j in range(len(seeds))])

    def compare(frames):
        for f in frames:
            group = f["block"].to_numpy() ^ f["o"].to_numpy()
            found, edges = [], []
            for a, b in split_runs(group):
                for s in range(a, b, WINDOW):
                    e = min(b, s + WINDOW)
                    if e - s > 1:
                        got, link = best_pairs(f["node"].to_numpy()[s:e], unit(f["v"].iloc[s:e]), START_KEEP, threshold)
                        found.append(got)
                        edges.append(link)
            yield pair_frame(found, edges, threshold)

    rows = vectors.select("node", "block", "v").mapInPandas(
        code, f"node long, block long, v {kind(vectors)}, o int, code long")
    order = ["o", "block", "code", "tie"]
    return (rows.withColumn("tie", F.xxhash64("node", "o")).repartitionByRange(*order)
            .sortWithinPartitions(*order).mapInPandas(compare, PAIRS))


def lists(pairs: DataFrame, old: DataFrame | None, threshold: float) -> DataFrame:
    """Stored (a, b, s, k): the best k of old lists and new pairs, both ways."""
    p = pairs.where("NOT edge").select("a", "b", "s")
    p = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    if old is not None:
        p = p.unionByName(old.select("a", "b", "s"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    p = p.distinct().withColumn("r", rank).where(F.col("r") <= LIST_MAX)
    k = (old.groupBy(F.col("a").alias("ka")).agg(F.first("k").alias("k0"), F.min("s").alias("low"),
                                                 F.count(F.lit(1)).alias("n")) if old is not None else None)
    if k is None:
        return stage(p.where(F.col("r") <= LIST).select("a", "b", "s", F.lit(LIST).alias("k")), "nn_lists")
    full = (F.col("low") >= threshold) & (F.col("n") >= F.col("k0"))   # saturated: the list doubles
    k = stage(k.select("ka", F.least(F.lit(LIST_MAX), F.when(full, F.col("k0") * 2).otherwise(F.col("k0"))).alias("k")),
              "nn_sizes")
    p = p.join(k, F.col("a") == F.col("ka"), "left").withColumn("k", F.coalesce("k", F.lit(LIST)))
    return stage(p.where(F.col("r") <= F.col("k")).select("a", "b", "s", "k"), "nn_lists")


def refine(vectors: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Pairs among the neighbours (both ways) of every vector, in groups of
    at most WINDOW."""
    own = graph.groupBy("a").agg(F.collect_list("b").alias("known"), F.min("s").alias("worst"),
                                 F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
    own = stage(vectors.select("node", "v").join(own, F.col("node") == F.col("a"))
                .select(F.col("node").alias("m"), "v", "known",
                        F.when(F.col("n") < F.col("k"), F.lit(-2.0)).otherwise(F.col("worst")).alias("worst")), "nn_own")
    near = graph.select(F.col("a").alias("c"), F.col("b").alias("p"))
    near = near.unionByName(near.select(F.col("p").alias("c"), F.col("c").alias("p"))).distinct()
    rows = stage(near, "nn_near").join(own, F.col("p") == F.col("m")).select("c", "m", "v", "known", "worst")

    def compare(frames):
        for f in frames:
            found, edges = [], []
            for a, b in split_runs(f["c"].to_numpy()):
                for s in range(a, b, WINDOW):
                    e = min(b, s + WINDOW)
                    if e - s > 1:
                        p = f.iloc[s:e]
                        got, link = best_pairs(p["m"].to_numpy(), unit(p["v"]), LIST, threshold,
                                               p["worst"].to_numpy(), [np.asarray(x) for x in p["known"]])
                        found.append(got)
                        edges.append(link)
            yield pair_frame(found, edges, threshold)

    order = ["c", "tie"]
    return (rows.withColumn("tie", F.xxhash64("m", "c")).repartitionByRange(*order)
            .sortWithinPartitions(*order).mapInPandas(compare, PAIRS))


def growing(graph: DataFrame, threshold: float) -> bool:
    """Whether a list is full of links and may still be enlarged."""
    full = graph.groupBy("a").agg(F.first("k").alias("k"), F.min("s").alias("low"), F.count(F.lit(1)).alias("n"))
    return not full.where((F.col("n") >= F.col("k")) & (F.col("low") >= threshold) & (F.col("k") < LIST_MAX)).isEmpty()


def descend(vectors: DataFrame, seeds: list[int], threshold: float, rounds: int) -> DataFrame:
    """Stored edges (a, b) of one start and its refinement."""
    pairs = stage(start(vectors, seeds, threshold), "nn_start")
    edges = pairs.where("edge").select("a", "b")
    graph = lists(pairs, None, threshold)
    for _ in range(rounds):
        pairs = stage(refine(vectors, graph, threshold), "nn_refine")
        edges = edges.unionByName(pairs.where("edge").select("a", "b"))
        graph = lists(pairs, graph, threshold)
        if pairs.where("fresh").isEmpty() and not growing(graph, threshold):
            break
    return stage(edges.distinct(), "nn_edges")


def count_links(vectors: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """Stored (node, others): copies of other vectors linked to each member of
    a component, by comparing its members chunk against chunk."""
    sizes = stage(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
                  .select(F.col("component").alias("sc"), "size"), "nn_sizes")
    m = stage(comp.join(sizes, F.col("component") == F.col("sc")).select("node", "component", "size"), "nn_members")
    m = m.join(vectors.select(F.col("node").alias("vn"), "v", "copies"), F.col("node") == F.col("vn"))

    def count(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in split_runs(f["cell"].to_numpy()):
            p = f.iloc[a:b]
            node, part, copies = p["node"].to_numpy(), p["part"].to_numpy(), p["copies"].to_numpy(dtype=np.float64)
            x = unit(p["v"])
            alone = bool(p["alone"].iloc[0]) and bool(p["alone"].all())
            ok = x @ x.T >= threshold
            ok &= (node[:, None] != node[None, :]) if alone else (part[:, None] != part[None, :])
            out.append(pd.DataFrame({"node": node, "others": (ok @ copies).astype(np.int64)}))
        return pd.concat(out)

    dealt = cells(m.select("node", "component", "size", "v", "copies"), "component", "size", COUNT_CHUNK)
    got = map_groups(dealt.select("cell", "node", "part", "alone", "v", "copies"), "cell", count,
                     "node long, others long")
    return stage(got.groupBy(F.col("node").alias("on")).agg(F.sum("others").alias("others")), "nn_counts")


def audit(vectors: DataFrame, counts: DataFrame, threshold: float, rows: int) -> tuple[int, int]:
    """(vectors whose links are all found, vectors) of a bounded sample, compared
    with all vectors."""
    sample = vectors.orderBy(F.xxhash64("node", F.lit(77))).limit(rows).select("node", "block", "v").collect()
    if not sample:
        return 0, 0
    blocks: dict[int, list] = {}
    for r in sample:
        blocks.setdefault(r.block, []).append(r)
    probe = {b: (np.array([r.node for r in rs]), unit([r.v for r in rs])) for b, rs in blocks.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(probe)   # at most ``rows`` vectors

    def compare(frames):
        there: dict[int, int] = {}
        for f in frames:
            for b, p in f.groupby("block"):
                if b not in shared.value:
                    continue
                node, x = shared.value[b]
                ok = (x @ unit(p["v"]).T >= threshold) & (node[:, None] != p["node"].to_numpy()[None, :])
                for n, k in zip(node.tolist(), (ok @ p["copies"].to_numpy(dtype=np.float64)).tolist()):
                    there[n] = there.get(n, 0) + int(k)
        if there:
            yield pd.DataFrame({"node": list(there), "n": list(there.values())})

    true = {r.node: r.n for r in vectors.select("node", "block", "v", "copies").mapInPandas(compare, "node long, n long")
            .groupBy("node").agg(F.sum("n").alias("n")).collect()}
    ids = vectors.sparkSession.createDataFrame([(int(r.node),) for r in sample], "sn long")
    found = {r["on"]: r.others for r in counts.join(F.broadcast(ids), F.col("on") == F.col("sn")).collect()}
    return sum(found.get(n, 0) >= k for n, k in true.items()), len(true)


def cut(f: pd.DataFrame, chunk: int) -> list[int]:
    """Starts of the chunks of a sorted frame: where the label changes, where a
    component of TIGHT members or more begins or ends, and every ``chunk`` rows."""
    starts = []
    for a, b in split_runs(f["block"].to_numpy()):
        edges = {a}
        for s, e in split_runs(f["comp"].to_numpy()[a:b]):
            if f["comp"].iloc[a + s] >= 0 and e - s >= TIGHT:
                edges |= {a + s, a + e}
        edges = sorted(edges - {b}) + [b]
        for s, e in zip(edges, edges[1:]):
            starts += range(s, e, chunk)
    return starts


def chunked(vectors: DataFrame, comp: DataFrame, chunk: int) -> DataFrame:
    """Stored (chunk, node, block, comp, v), comp -1 without a component; the first
    row of a chunk also has its centre, radius (angle) and only component."""
    rows = vectors.select("node", "block", "v").join(
        comp.select(F.col("node").alias("cn"), "component"), F.col("node") == F.col("cn"), "left")
    rows = rows.select("node", "block", "v", F.coalesce("component", F.lit(-1).cast("long")).alias("comp"))

    def code(frames):
        for f in frames:
            yield f.assign(code=codes(f["v"].tolist(), [0])[:, 0])

    def described(f, number):
        x = unit(f["v"])
        c = x.sum(axis=0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ c, -1.0, 1.0)).max())
        comp = f["comp"].to_numpy()
        only = int(comp[0]) if (comp == comp[0]).all() else -1
        rest = [None] * (len(f) - 1)
        return pd.DataFrame({"chunk": number, "node": f["node"].to_numpy(), "block": f["block"].to_numpy(), "comp": comp,
                             "v": f["v"].to_list(), "centre": [c.tolist(), *rest], "radius": [radius, *rest],
                             "only": pd.array([only, *rest], dtype="Int64")})

    def run(frames):
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= 4 * chunk:
                p = pd.concat(held, ignore_index=True)
                starts = cut(p, chunk)
                for a, b in zip(starts, starts[1:]):
                    yield described(p.iloc[a:b], number)
                    number += 1
                held, n = [p.iloc[starts[-1]:]], len(p) - starts[-1]
        if n:
            p = pd.concat(held, ignore_index=True)
            starts = cut(p, chunk)
            for a, b in zip(starts, [*starts[1:], len(p)]):
                yield described(p.iloc[a:b], number)
                number += 1

    order = ["block", "comp", "code", "node"]
    coded = rows.mapInPandas(code, f"node long, block long, v {kind(vectors)}, comp long, code long")
    return stage(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        run, f"chunk long, node long, block long, comp long, v {kind(vectors)}, centre array<double>, radius double, only long"),
        "nn_chunks")


def between(vectors: DataFrame, comp: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """Stored edges (a, b): the star forest of all links between vectors of
    different components (or of none)."""
    rows = chunked(vectors, comp, chunk)
    centres = stage(rows.where("centre IS NOT NULL").select(F.col("chunk").alias("node"), "block", "centre", "radius", "only"),
                    "nn_centres")
    sizes = centres.groupBy(F.col("block").alias("sb")).agg(F.count(F.lit(1)).alias("size"))
    centres = centres.join(sizes, F.col("block") == F.col("sb")).drop("sb")
    reach = math.acos(threshold) + SLACK

    def near(f: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for a, b in split_runs(f["cell"].to_numpy()):
            p = f.iloc[a:b]
            c = np.stack(p["centre"])
            r, only, part = p["radius"].to_numpy(), p["only"].to_numpy(), p["part"].to_numpy()
            ok = np.arccos(np.clip(c @ c.T, -1.0, 1.0)) <= r[:, None] + r[None, :] + reach
            ok &= (only[:, None] != only[None, :]) | (only[:, None] < 0)
            alone = bool(p["alone"].all())
            if not alone:
                ok &= part[:, None] != part[None, :]
            i, j = np.nonzero(np.triu(ok, 0 if alone else 1))
            out.append(pd.DataFrame({"x": p["node"].to_numpy()[i], "y": p["node"].to_numpy()[j]}))
        return pd.concat(out)

    pairs = map_groups(cells(centres, "block", "size", CENTRES).select("cell", "part", "alone", "node", "centre", "radius", "only"),
                       "cell", near, "x long, y long")
    pairs = stage(pairs.select(F.monotonically_increasing_id().alias("pair"), "x", "y"), "nn_chunk_pairs")
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("x", "y"))).alias("side"))
    dealt = sides.join(rows.select("chunk", "node", "comp", "v"), F.col("side") == F.col("chunk")).select("pair", "node", "comp", "v")

    def compare(f: pd.DataFrame) -> pd.DataFrame | None:
        edges = []
        for a, b in split_runs(f["pair"].to_numpy()):
            node, comp = f["node"].to_numpy()[a:b], f["comp"].to_numpy()[a:b]
            x = unit(f["v"].iloc[a:b])
            ok = (x @ x.T >= threshold) & ((comp[:, None] != comp[None, :]) | (comp[:, None] < 0))
            i, j = np.nonzero(np.triu(ok, 1))
            edges.append((node[i], node[j]))
        n, r = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        m = n != r
        return pd.DataFrame({"a": n[m], "b": r[m]})

    return stage(map_groups(dealt, "pair", compare, "a long, b long"), "nn_between")


def near_vectors(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = COSINE, rounds: int = ROUNDS, audit_rows: int = AUDIT_ROWS,
                 chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``key``, n_links, component_id, kept.

    Vectors of one (non-null) label and length are linked when their cosine in
    double precision is at least ``threshold``; component_id is the smallest
    key reachable by links. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a label, link with nothing. Exact
    copies are linked. Repeated rows count as vectors; of rows that repeat the
    smallest key all have kept = true. A null key is never kept. An empty
    table gives an empty result. Other columns are not read.
    """
    # doubles stay doubles; other components are exact as floats
    exact = "array<double>" if "double" in rows.schema[embedding].dataType.simpleString() else "array<float>"
    values = F.col(embedding).cast(exact)
    a = stage(rows.select(F.col(key).cast("long").alias("id"), values.alias("v"),
                          F.col(label).alias("label"), valid(embedding, label).alias("ok")), "nn_rows")
    vectors = distinct_vectors(a)
    largest = vectors.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    tables = tables_needed(largest)
    edges, comp, counts = None, None, None
    for attempt in range(AUDITS):
        seeds = [attempt * 1000 + i for i in range(tables)]
        more = descend(vectors, seeds, threshold, rounds)
        edges = more if edges is None else edges.unionByName(more)
        comp = stage(components(edges, "nn_links"), "nn_components")
        counts = count_links(vectors, comp, threshold)
        whole, sampled = audit(vectors, counts, threshold, audit_rows)
        if whole == sampled:
            break
    missed = between(vectors, comp, threshold, chunk)
    if not missed.isEmpty():
        comp = stage(components(edges.unionByName(missed), "nn_links"), "nn_components")
        counts = count_links(vectors, comp, threshold)
    named = stage(vectors.select("node", "id").join(comp.select(F.col("node").alias("cn"), "component"),
                                                    F.col("node") == F.col("cn"), "left")
                  .select("node", "id", F.coalesce("component", "node").alias("comp")), "nn_named")
    low = stage(named.groupBy("comp").agg(F.min("id").alias("component_id"))
                .select(F.col("comp").alias("lc"), "component_id"), "nn_low")
    named = named.join(low, F.col("comp") == F.col("lc")).select(F.col("node").alias("nn"), "component_id")
    per = vectors.join(named, F.col("node") == F.col("nn")).join(counts, F.col("node") == F.col("on"), "left")
    # the vector itself names its row: label and components, as grouped above
    per = stage(per.select(F.xxhash64("block", "v").alias("ph"), F.col("v").alias("pv"), F.col("block").alias("pb"),
                           "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
                "nn_result")
    good = a.where("ok").withColumn("block", F.xxhash64("label", F.size("v")))
    good = good.join(per, (F.xxhash64("block", "v") == F.col("ph")) & (F.col("v") == F.col("pv"))
                     & (F.col("block") == F.col("pb")))
    out = good.select("id", "n_links", "component_id").unionByName(
        a.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
