"""Hierarchical multi-length packing.

Context tiers are powers of two up to ``window``. Each task streams its
documents through a buffer of tokens, and when the buffer is full

1. routes: a document longer than the window gives whole windows, its rest
   (like every shorter document) goes to the smallest tier it fits;
2. packs each tier from the longest down: the tier's longest documents open
   sequences, the gap is filled with the largest shorter document that fits
   (of this or a shorter tier), and the last gap with the head of a document
   that is cut there, so sequences leave full;
3. keeps what cannot fill a sequence of its tier for the tier above, and what
   cannot fill the longest for the next buffer.

At the end of a task the rest goes out as full windows and then as contexts of
falling powers of two, so nothing is padded. Sequences of a tier are then
dealt into step groups of equal token counts: running numbers per tier come
from a table of counts per task.

Ids never leave the task that made them: a piece carries its length and
CRC-32. Nothing is shuffled but that count table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import back, ids
from panelforge.llm.tokens import word_ids
from panelforge.sources.io import stage

WINDOW = 4096
SHORTEST = 512                 # shortest tier that packs several documents
BUFFER_TOKENS = 1_000_000      # tokens a task holds at a time
STEP_TOKENS = 64 * WINDOW      # tokens of a step group

PIECES = ("id long, z boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, part int, tier_no long")


class Packer:
    """Packs documents (id, ids as 4-byte little-endian) of one task."""

    def __init__(self, part: int, window: int = WINDOW, shortest: int = SHORTEST,
                 buffer_tokens: int = BUFFER_TOKENS):
        self.part, self.window, self.buffer_tokens = part, window, buffer_tokens
        self.tiers = []
        t = min(shortest, window)
        while t <= window:
            self.tiers.append(t)
            t *= 2
        self.pool: list[tuple[int, int]] = []     # (length, slot), ascending: rests of all tiers
        self.docs: dict[int, list] = {}           # slot -> [id, bytes, start, tokens of the document]
        self.held = 0
        self.slot = 0
        self.rows: list[tuple] = []
        self.made = 0
        self.by_tier: dict[int, int] = {}

    def add(self, key, ids: bytes) -> None:
        n = len(ids) // 4
        start = 0
        while n - start >= self.window:            # whole windows of a long document
            self._emit(self.window, [(key, ids, start, self.window, n)])
            start += self.window
        if n > start:
            self.docs[self.slot] = [key, ids[4 * start:], start, n]
            self._put(n - start, self.slot)
            self.slot += 1
        if self.held >= self.buffer_tokens:
            self._pack()

    def _put(self, length: int, slot: int) -> None:
        insort(self.pool, (length, slot))
        self.held += length

    def _take(self, at: int) -> tuple[int, int]:
        length, slot = self.pool.pop(at)
        self.held -= length
        return length, slot

    def _emit(self, tier: int, pieces) -> None:
        no = self.by_tier.get(tier, 0)
        self.by_tier[tier] = no + 1
        seq = (self.part << 33) + self.made
        self.made += 1
        at = 0
        for key, ids, start, length, tokens, *skip in pieces:
            lo = 4 * (skip[0] if skip else start)
            self.rows.append((key, start, length, zlib.crc32(ids[lo: lo + 4 * length]), tokens, seq, at,
                              tier, self.part, no))
            at += length

    def _cut(self, slot: int, length: int):
        """Head of a held document as a piece; the tail stays in the pool."""
        key, ids, start, tokens = self.docs[slot]
        rest = len(ids) // 4 - length
        if rest:
            self.docs[slot] = [key, ids[4 * length:], start + length, tokens]
            self._put(rest, slot)
        else:
            del self.docs[slot]
        return key, ids, start, length, tokens, 0

    def _fill(self, tier: int) -> None:
        """One full sequence of ``tier`` from the pool (held >= tier)."""
        pieces, gap = [], tier
        while gap:
            at = bisect_right(self.pool, (gap, 1 << 62)) - 1   # largest document that fits the gap
            if at < 0:
                at = 0                                          # none does: cut the shortest
            length, slot = self._take(at)
            pieces.append(self._cut(slot, min(length, gap)))
            gap -= min(length, gap)
        self._emit(tier, pieces)

    def _pack(self) -> None:
        """Pack the buffer: the longest tier opens with its own documents and
        closes its gaps from the shorter ones; a shorter tier keeps half of the
        documents routed to it for sequences of its own length."""
        for tier in reversed(self.tiers):
            low = tier // 2 if tier != self.tiers[0] else 0
            mine = len(self.pool) - bisect_right(self.pool, (low, 1 << 62))
            own = sum(n for n, _ in self.pool[len(self.pool) - mine:])
            for _ in range(min(self.held, own) // tier if tier == self.window else own // (2 * tier)):
                self._fill(tier)
        while self.held >= max(self.window, self.buffer_tokens // 2):
            self._fill(self.window)

    def finish(self) -> None:
        """Everything left: full windows, then contexts of falling powers of two."""
        if self.held >= self.window:
            self._pack()
        while self.held >= self.window:
            self._fill(self.window)
        while self.held:
            self._fill(1 << (self.held.bit_length() - 1))

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, key: str = "doc_id",
         text: str = "text", window: int = WINDOW, shortest: int = SHORTEST,
         buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (context length), step (group of its tier).

    A document is its token ids and ``end_id``; a null or empty text is
    ``end_id`` alone. Documents are cut only where a sequence ends. Repeated
    rows and rows with a null key are documents like any other. An empty table
    gives an empty result. Columns other than ``key`` and ``text`` are not read.
    ``tokenizer`` is a path or the name of a public tokenizer file.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]

    def frame(rows):
        return pd.DataFrame([(*r[0], *r[1:]) for r in rows], columns=names)

    def run(frames):
        from pyspark import TaskContext
        enc = word_ids(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        p = Packer(TaskContext.get().partitionId(), window, shortest, buffer_tokens)
        for f in frames:
            for i, z, t in zip(f["id"].tolist(), f["z"].tolist(), f["text"].tolist()):
                p.add((i, z), enc.text(t) + end)
            if p.rows:
                yield frame(p.take_rows())
        p.finish()
        if p.rows:
            yield frame(p.take_rows())

    rows = docs.select(*ids(key), F.col(text).alias("text"))
    pieces = stage(rows.mapInPandas(run, PIECES), "pack_pieces")
    per = pieces.where("offset = 0").groupBy("tier", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("tier").alias("t"), F.col("part").alias("p"),
                     F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    # one row per task and tier: bounded by the number of input splits
    out = pieces.join(per, (F.col("tier") == F.col("t")) & (F.col("part") == F.col("p")))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    step = F.floor((F.col("base") + F.col("tier_no")) / per_step).cast("long")
    return out.select(back(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                      "offset", "tier", step.alias("step"))

