"""License scan as an exact set-similarity join of text blocks with templates.

A block is a window of W words, one starting every W / 2 words, where W is the
power of two that holds a template twice: any run of as many words as the
template has lies whole in one of its blocks. A block meets a template when it
holds at least ``need`` = ceil(threshold * |T|) of the template's |T| distinct
words. Every such pair is found:

1. Order: words are ranked by the number of documents that hold them, rarest
   first, over the whole corpus. Words of no template add to no overlap, so a
   block is the set of its template words.
2. Prefix filter: a pair with overlap ``need`` shares a word among the first
   |T| - need + 1 of the template and the first |B| - need + 1 of the block.
   Blocks without a prefix word of their length class are never built.
3. Length filter: |B| >= need. Positional filter: the first common word, at
   places i and j, leaves at most min(|T| - i, |B| - j) in common.
4. What is left is verified on whole sets.

The templates are a parameter and their table is broadcast: it is as small as
the list the caller writes. Block rows join it where they lie; only the
matches are shuffled, by row number.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import back, ids
from panelforge.sources.io import stage

# Phrases of the contract (fixed values).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Public licence notices: (label, threshold, text). Short ones must be whole,
# since one word tells them apart; long ones may miss a fifth of their words.
TEMPLATES = [
    ("apache", 1.0, "Licensed under the Apache License, Version 2.0"),
    ("apache", 0.8, "you may not use this file except in compliance with the License. You may obtain a copy of the "
                    "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", 0.8, "Unless required by applicable law or agreed to in writing, software distributed under the License "
                    "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                    "implied. See the License for the specific language governing permissions and limitations under "
                    "the License."),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met"),
    ("bsd", 0.8, "Redistributions of source code must retain the above copyright notice, this list of conditions and "
                 "the following disclaimer"),
    ("cc", 1.0, "Licensed under CC BY 4.0"),
    ("cc", 1.0, "Licensed under CC BY-NC 4.0"),
    ("cc", 1.0, "Licensed under CC BY-SA 4.0"),
    ("cc", 0.8, "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy "
                "of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("gpl", 1.0, "licensed under the GNU General Public License"),
    ("gpl", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                 "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                 "all copies."),
    ("lgpl", 1.0, "GNU Lesser General Public License"),
    ("mit", 1.0, "Released under the MIT License"),
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the Software), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software"),
    ("mpl", 0.8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                 "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", 0.8, "This is free and unencumbered software released into the public domain."),
]

# A-Z lower-cased; digits, a-z and all bytes from 0x80 on stay; the rest separates.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text (UTF-8)."""
    return text.encode().translate(_BYTES).split() if text else []


class Template:
    """One template: its distinct words, how many of them a block needs, and
    the length class (window) it is looked for in."""

    def __init__(self, label: str, threshold: float, text: str):
        w = words(text)
        if not w or not 0 < threshold <= 1:
            raise ValueError(f"template of {label!r} needs words and a threshold in (0, 1]")
        self.label, self.words = label, frozenset(w)
        self.need = math.ceil(threshold * len(self.words) - 1e-9)
        self.window = 2 << (len(w) - 1).bit_length()


def document_counts(docs: DataFrame, text: str, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each wanted word (one row a word reaches the driver)."""
    def run(frames):
        for f in frames:
            n: dict[bytes, int] = {}
            for t in f["t"]:
                for w in wanted.intersection(words(t)):
                    n[w] = n.get(w, 0) + 1
            yield pd.DataFrame({"w": list(n), "n": list(n.values())})

    counts = docs.select(F.col(text).alias("t")).mapInPandas(run, "w binary, n long")
    return {bytes(r["w"]): r["n"] for r in counts.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts, in a text of words with one
    space before, between and after them."""
    out, word, seen, at = [], 0, 0, joined.find(phrase)
    while at >= 0:
        word += joined.count(b" ", seen, at)
        out.append(word)
        seen, at = at, joined.find(phrase, at + 1)
    return out


def blocks_of(w: list[bytes], rank: dict[bytes, int], first: dict[int, frozenset[bytes]],
              least: dict[int, int]) -> list[tuple[int, int, list[int]]]:
    """(window, first word, ranks in order) of the blocks that hold a prefix
    word of their length class and enough template words at all."""
    here = {win: p for win, p in first.items() if not p.isdisjoint(w)}
    if not here:
        return []
    at, of = [], []
    for i, x in enumerate(w):
        r = rank.get(x)
        if r is not None:
            at.append(i)
            of.append(r)
    out = []
    for win, prefix in here.items():
        half = win // 2
        low = {rank[x] for x in prefix}
        ks = {i // half for i, r in zip(at, of) if r in low}
        for k in sorted(ks | {k - 1 for k in ks if k}):
            a, b = bisect_left(at, k * half), bisect_left(at, k * half + win)
            have = sorted(set(of[a:b]))
            if len(have) >= least[win]:
                out.append((win, k * half, have))
    return out


def scanned(docs: DataFrame, key: str, text: str, templates: list[Template]) -> tuple[DataFrame, dict[bytes, int]]:
    """Stored rows (uid, id, z, n_words, n_base, first_word, last_word, base,
    blocks) and the rank of each template word."""
    universe = frozenset().union(*[t.words for t in templates])
    held = document_counts(docs, text, universe)
    rank = {w: r for r, w in enumerate(sorted(universe, key=lambda w: (held.get(w, 0), w)))}
    first: dict[int, frozenset[bytes]] = {}
    least: dict[int, int] = {}
    for t in templates:
        prefix = sorted(t.words, key=rank.get)[:len(t.words) - t.need + 1]
        first[t.window] = first.get(t.window, frozenset()).union(prefix)
        least[t.window] = min(least.get(t.window, t.need), t.need)
    phrases = [(label, b" %s " % p.encode()) for label, p in PHRASES]

    def run(frames):
        for f in frames:
            out = []
            for i, z, t in zip(f["id"].tolist(), f["z"].tolist(), f["t"]):
                w = words(t)
                joined = b" %s " % b" ".join(w)
                hits = [(label, p) for label, phrase in phrases for p in places(joined, phrase)]
                at = [p for _, p in hits]
                out.append((i, z, len(w), len(at), min(at, default=None), max(at, default=None),
                            sorted({label for label, _ in hits}), blocks_of(w, rank, first, least)))
            yield pd.DataFrame(out, dtype=object, columns=["id", "z", "n_words", "n_base", "first_word", "last_word",
                                                           "base", "blocks"])

    rows = docs.select(*ids(key), F.col(text).alias("t")).mapInPandas(
        run, "id long, z boolean, n_words long, n_base long, first_word long, last_word long, base array<string>, "
             "blocks array<struct<window: int, start: int, ranks: array<int>>>")
    return stage(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "license_scan"), rank


def containment_join(blocks: DataFrame, templates: list[Template], rank: dict[bytes, int]) -> DataFrame:
    """Rows of ``blocks`` (window, start, ranks and others) that hold enough of
    a template: adds label, template (number in the list) and containment. A
    pair appears once per prefix word that it shares."""
    spark = blocks.sparkSession
    rows = []
    for number, t in enumerate(templates):
        order = sorted(rank[w] for w in t.words)
        rows += [(t.window, word, i, len(order), t.need, number, t.label, order)
                 for i, word in enumerate(order[:len(order) - t.need + 1])]
    prefixes = spark.createDataFrame(rows, "__w int, __word int, __i int, __n int, __need int, template int, "
                                           "label string, __t array<int>")
    b = blocks.withColumn("__b", F.size("ranks"))
    b = b.select("*", F.posexplode("ranks").alias("__j", "__x"))
    pairs = b.join(F.broadcast(prefixes), (F.col("window") == F.col("__w")) & (F.col("__x") == F.col("__word")))
    pairs = pairs.where((F.col("__b") >= F.col("__need"))
                        & (F.least(F.col("__n") - F.col("__i"), F.col("__b") - F.col("__j")) >= F.col("__need")))
    pairs = pairs.withColumn("__o", F.size(F.array_intersect("ranks", "__t"))).where("__o >= __need")
    return pairs.select(*blocks.columns, "label", "template", (F.col("__o") / F.col("__n")).alias("containment"))


def license_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Every block that meets a template: ``key``, label, template, window,
    start (first word of the block), containment."""
    ts = [Template(*t) for t in templates]
    if not ts:
        raise ValueError("no templates")
    rows, rank = scanned(docs, key, text, ts)
    found = containment_join(rows.select("id", "z", F.inline("blocks")), ts, rank)
    return (found.select(back(key), "label", "template", "window", "start", "containment")
            .dropDuplicates([key, "template", "start", "window"]))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per input row: ``key``, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    base_* tell of the fixed phrases; labels adds those of templates that some
    block of the text meets. score is 1 with a base phrase, else the largest
    containment met, else 0. Null text counts as empty (no words, empty label
    strings, null places). Rows are judged one by one, repeated ones too; other
    columns are not read.
    """
    ts = [Template(*t) for t in templates]
    if not ts:
        raise ValueError("no templates")
    rows, rank = scanned(docs, key, text, ts)
    found = containment_join(rows.select("uid", F.inline("blocks")), ts, rank)
    met = found.groupBy(F.col("uid").alias("muid")).agg(F.collect_set("label").alias("met"),
                                                        F.max("containment").alias("best"))
    out = rows.drop("blocks").join(met, F.col("uid") == F.col("muid"), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>"))))
    return out.select(
        back(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
