"""URL filter by a path-template tree.

Fixed rules decide what they fit. All other urls are judged by templates that
the tree of their host learns from all urls:

1. Segments that carry digits are generalised by shape (number, hexadecimal,
   mixed; with their extension).
2. Where the urls of a node part, its words stay literal or become the wildcard
   ``*`` by variability: the share of urls after the first that bring a new
   word. In a slot below VARIABLE all words stay; in a more variable one those
   whose repeats would be a chance of at most ALPHA at that variability. A word
   that passes the same test among the hosts (one vote a host) at its depth
   stays too, so a small host is read like a large one.
3. Literal siblings whose next segments have the same distribution of kinds and
   whose labelled shares agree (two G-tests at ALPHA) are merged into one branch.
   Siblings alike to an eighth are pooled before, which bounds what a task
   compares. Branches with labels and branches without are not merged: a merge
   must not hand a verdict to urls nobody labelled.
4. Purity is smoothed by the ancestors: labelled urls of the template and
   STRENGTH urls at the prior that its parent hands down. A node's prior for its
   children counts its labelled urls as they are and its others (and STRENGTH
   more) at the prior from above; the root's is the blocked share of all urls.
   So labels weigh below a node in the measure in which they cover it. A template
   is rejected when its purity is at least CUT, with labels of its own or without.
   Labels are the urls that the fixed rules decide, and any that the caller adds.

All levels count: where all urls of a node share their next segments, these are
one step, so there are as many rounds as levels at which urls part.

Every step is an aggregate over (host, template, segment); a host with most of
the urls is split by its templates and joined as plain tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import map_groups, small_side, split_runs
from panelforge.sources.io import stage

# Rules of the contract: (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

VARIABLE = 0.1
ALPHA = 0.01
STRENGTH = 2.0
CUT = 0.5
GRADES = 8         # shares of branches that are pooled agree to 1 / GRADES
SHOWN = 8          # segments of a template's name; what follows is written /**
KINDS = ["end", "word", "number", "hex", "mixed"]   # of a next segment


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def kind(seg: Column) -> Column:
    stem = F.regexp_replace(seg, r"\.[A-Za-z]{1,5}$", "")
    return (F.when(seg.isNull(), "end").when(stem.rlike("^[0-9]+$"), "number")
            .when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "hex")
            .when(stem.rlike("[0-9]"), "mixed").otherwise("word"))


def symbol(seg: Column) -> Column:
    """The literal word, or ``{shape}`` with its extension."""
    ext = F.regexp_extract(seg, r"(\.[A-Za-z]{1,5})$", 1)
    k = kind(seg)
    return F.when(k == "word", seg).otherwise(F.concat(F.lit("{"), k, F.lit("}"), ext))


def _g_tail(a: list[float], b: list[float]) -> float:
    """p-value of "a and b have one distribution" (G-test, chi-squared tail by
    Wilson and Hilferty's cube root)."""
    cells = [(x, y) for x, y in zip(a, b) if x + y > 0]
    na, nb = sum(a), sum(b)
    if len(cells) < 2 or not na or not nb:
        return 1.0
    g = 0.0
    for x, y in cells:
        for o, n in ((x, na), (y, nb)):
            if o:
                g += 2 * o * math.log(o * (na + nb) / (n * (x + y)))
    k = len(cells) - 1
    z = ((max(g, 0.0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def merge_branches(branches: list[tuple]) -> dict[str, str]:
    """(name, counts of next kinds, blocked, allowed) -> name of its branch.
    Larger branches lead, ties by name; a branch joins the first that fits."""
    pools: list[list] = []
    out = {}
    for name, hist, blocked, allowed in sorted(branches, key=lambda b: (-sum(b[1]), b[0])):
        for p in pools:
            both = bool(blocked + allowed), bool(p[2] + p[3])
            if both[0] != both[1]:
                continue
            if _g_tail(p[1], hist) >= ALPHA and _g_tail([p[2], p[3]], [blocked, allowed]) >= ALPHA:
                p[1] = [x + y for x, y in zip(p[1], hist)]
                p[2] += blocked
                p[3] += allowed
                out[name] = p[0]
                break
        else:
            pools.append([name, list(hist), blocked, allowed])
            out[name] = name
    return out


def keeps(count: str, urls: str, distinct: str) -> str:
    """SQL: a word with ``count`` of a slot's ``urls`` stays literal."""
    v = f"(({distinct} - 1) / greatest({urls} - 1, 1))"
    return f"({v} < {VARIABLE} OR pow(1 - {v}, {count} - 1) <= {ALPHA})"


def known_words(x: DataFrame) -> DataFrame:
    """Stored (depth, word) that stay literal when every host votes once."""
    votes = x.select("host", F.posexplode("rest").alias("depth", "word")).where("NOT startswith(word, '{')").distinct()
    words = stage(votes.groupBy("depth", "word").agg(F.count(F.lit(1)).alias("hosts")), "url_words")
    slots = words.groupBy(F.col("depth").alias("sd")).agg(F.sum("hosts").alias("votes"), F.count(F.lit(1)).alias("words"))
    return stage(words.join(slots, F.col("depth") == F.col("sd")).where(keeps("hosts", "votes", "words"))
                 .select(F.col("depth").alias("kd"), F.col("word").alias("kw")), "url_known")


def templates(urls: DataFrame, rate: float, strength: float = STRENGTH) -> DataFrame:
    """(host, path, blocked, allowed, n), one row per distinct url path, to
    (host, path, template, purity); ``rate`` is the root's prior."""
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    x = stage(urls.select("*", F.transform(segs, symbol).alias("rest"), F.lit("").alias("template"),
                          F.lit(False).alias("ended"), F.lit(float(rate)).alias("prior")), "url_paths")
    known = small_side(known_words(x), 100)
    counts = [f"k{i}" for i in range(len(KINDS))]
    sums = ["n", "blocked", "allowed", *counts]

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, b in split_runs(f["node"].to_numpy()):
            p = f.iloc[a:b]
            to = merge_branches([(w, [float(v) for v in h], float(bl), float(al)) for w, h, bl, al in
                                 zip(p["word"], p[counts].to_numpy(), p["blocked"], p["allowed"])])
            out += [(h, t, g, to[w]) for h, t, g, w in zip(p["host"], p["template"], p["grade"], p["word"])]
        return pd.DataFrame(out, columns=["mh", "mt", "mg", "into"])

    done = []
    while True:
        nodes = x.groupBy("host", "template", "ended").agg(
            *[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")], F.max("prior").alias("prior"),
            F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        # what all urls of a node share is what its least and greatest share
        parts = "array_position(zip_with(lo, hi, (a, b) -> a <=> b), false)"
        nodes = nodes.selectExpr(
            "host AS nh", "template AS nt", "ended AS ne", "lo = hi AS leaf",
            f"cast(CASE WHEN {parts} = 0 THEN size(lo) ELSE {parts} - 1 END AS int) AS shared", "lo",
            f"(blocked + {strength}D * prior) / (blocked + allowed + {strength}D) AS purity",
            f"(blocked + (n - blocked - allowed + {strength}D) * prior) / (n + {strength}D) AS handed")
        nodes = stage(nodes.selectExpr("nh", "nt", "ne", "leaf", "shared", "purity", "handed",
                                       "concat(nt, array_join(transform(slice(lo, 1, shared), s -> concat('/', s)), '')) AS here"),
                      "url_nodes")
        x = x.join(small_side(nodes, 400), (F.col("host") == F.col("nh")) & (F.col("template") == F.col("nt"))
                   & (F.col("ended") == F.col("ne")))
        x = stage(x.selectExpr("host", "path", "n", "blocked", "allowed", "leaf", "purity", "here AS template", "handed AS prior",
                               "slice(rest, shared + 1, greatest(size(rest) - shared, 0)) AS rest"), "url_level")
        done.append(x.where("leaf").select("host", "path", "template", "purity"))
        x = x.where("NOT leaf").drop("leaf", "purity").withColumn("sym", F.get("rest", F.lit(0)))
        if x.isEmpty():
            break
        nxt = F.get("rest", F.lit(1))
        what = F.when(nxt.isNull(), "end").when(nxt.startswith("{"), F.regexp_extract(nxt, "^.([a-z]*)", 1)).otherwise("word")
        child = stage(x.where("sym IS NOT NULL AND NOT startswith(sym, '{')").withColumn("next", what)
                      .groupBy("host", "template", "sym")
                      .agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")],
                           *[F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(c)
                             for k, c in zip(KINDS, counts)]), "url_children")
        total = child.groupBy(F.col("host").alias("th"), F.col("template").alias("tt")).agg(
            F.sum("n").alias("urls"), F.count(F.lit(1)).alias("words"))
        literal = (child.join(total, (F.col("host") == F.col("th")) & (F.col("template") == F.col("tt")))
                   .withColumn("depth", F.size(F.split("template", "/")) - 1)
                   .join(known, (F.col("depth") == F.col("kd")) & (F.col("sym") == F.col("kw")), "left")
                   .where(f"kw IS NOT NULL OR {keeps('n', 'urls', 'words')}"))
        grades = [f"round({GRADES} * {c} / n)" for c in counts]
        literal = stage(literal.selectExpr(
            "host", "template", "sym", *sums, f"concat_ws(',', {', '.join(grades)}, "
            f"CASE WHEN blocked + allowed > 0 THEN round({GRADES} * blocked / (blocked + allowed)) ELSE -1 END) AS grade"),
            "url_literals")
        # pools of a node are bounded: shares of five kinds and of labels, in eighths
        pools = literal.groupBy("host", "template", "grade").agg(
            *[F.sum(c).alias(c) for c in sums], F.min(F.struct(-F.col("n"), "sym")).alias("lead"))
        pools = pools.select("host", "template", "grade", "blocked", "allowed", *counts, F.col("lead.sym").alias("word"),
                             F.xxhash64("host", "template").alias("node"))
        merged = stage(map_groups(pools, "node", merge, "mh string, mt string, mg string, into string",
                                  order=("host", "template", "word")), "url_pools")
        named = stage(literal.join(merged, (F.col("host") == F.col("mh")) & (F.col("template") == F.col("mt"))
                                   & (F.col("grade") == F.col("mg")))
                      .select("mh", "mt", F.col("sym").alias("ms"), "into"), "url_branches")
        x = x.join(small_side(named, 300), (F.col("host") == F.col("mh")) & (F.col("template") == F.col("mt"))
                   & (F.col("sym") == F.col("ms")), "left")
        x = stage(x.selectExpr(
            "host", "path", "n", "blocked", "allowed", "prior", "sym IS NULL AS ended",
            "slice(rest, 2, greatest(size(rest) - 1, 0)) AS rest",
            "CASE WHEN sym IS NULL THEN template ELSE concat(template, '/', "
            "coalesce(into, CASE WHEN startswith(sym, '{') THEN sym END, '*')) END AS template"), "url_next")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url",
               rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None,
               strength: float = STRENGTH, cut: float = CUT) -> DataFrame:
    """One row per input row: ``key``, host, path, rule, verdict, template, purity.

    verdict is the rule's where one fits, else the template's; template and
    purity are null where a rule decides. ``labels`` (host, path, blocked
    boolean) adds labels for urls without a rule. Null urls and urls without
    ``://`` have an empty host and path and a template of their own. Repeated
    rows are judged alike and all count. An empty table gives an empty result;
    columns other than ``key`` and ``url`` are not read. Empty segments do not
    count; template names show SHOWN segments, decisions use all of them.
    """
    host, path = split_url(url)
    rows = pages.select(F.col(key).alias("__key"), host.alias("host"), path.alias("path"))
    rule, word = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = stage(rows.withColumn("rule", rule).withColumn("word", word), "url_rows")
    known = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.coalesce("word", F.lit("")) == "block").cast("long")).alias("blocked"),
        F.sum((F.coalesce("word", F.lit("")) == "allow").cast("long")).alias("allowed"))
    if labels is not None:
        more = stage(labels.groupBy(F.col("host").alias("lh"), F.col("path").alias("lp")).agg(
            F.sum(F.col("blocked").cast("long")).alias("b"), F.sum((~F.col("blocked")).cast("long")).alias("a")),
            "url_labels")
        known = known.join(more, (F.col("host") == F.col("lh")) & (F.col("path") == F.col("lp")), "left").select(
            "host", "path", "n", (F.col("blocked") + F.coalesce("b", F.lit(0))).alias("blocked"),
            (F.col("allowed") + F.coalesce("a", F.lit(0))).alias("allowed"))
    known = stage(known, "url_known_labels")
    sums = known.agg(F.sum("blocked"), F.sum("n")).first()
    rate = (sums[0] or 0) / sums[1] if sums[1] else 0.0
    shown = F.when(F.size(F.split("template", "/")) - 1 > SHOWN, F.concat(
        F.substring_index("template", "/", SHOWN + 1), F.lit("/**"))).otherwise(F.col("template"))
    verdicts = stage(templates(known, rate, strength).select(
        F.col("host").alias("vh"), F.col("path").alias("vp"), shown.alias("template"), "purity",
        (F.col("purity") >= cut).alias("rejected")), "url_verdicts")
    open_rows = rows.where("rule IS NULL").join(
        verdicts, (F.col("host") == F.col("vh")) & (F.col("path") == F.col("vp")))
    judged = open_rows.select(F.col("__key").alias(key), "host", "path", "rule",
                              F.when(F.col("rejected"), "block").otherwise("allow").alias("verdict"),
                              "template", "purity")
    ruled = rows.where("rule IS NOT NULL").select(F.col("__key").alias(key), "host", "path", "rule",
                                                  F.col("word").alias("verdict"),
                                                  F.lit(None).cast("string").alias("template"),
                                                  F.lit(None).cast("double").alias("purity"))
    return ruled.unionByName(judged)
