"""Fill-in-middle transformation on piece tables.

A document becomes descriptors (buffer, start, length) over two immutable
buffers, its text and the sentinels. Cutting splits descriptors, an arrangement
permutes them, and nothing is copied until a reader streams the descriptors.
The sequence restores by the same means: its own string is the buffer, the
sentinels' places give the descriptors, and the inverse permutation puts them
back in text order.

Which rows are changed, where they are cut and how they are arranged follows
from a hash of the key alone, so a task that runs again gives the same rows.
Memory: one batch of texts, and one rendered sequence at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import back, ids

TEXT, SENTINEL = 0, 1
# Sentinels and arrangements (fixed values of the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
MARKS = (PREFIX, MIDDLE, SUFFIX)         # sentinel of the 1st, 2nd and 3rd piece of the text
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}   # order of prefix 0, middle 1, suffix 2
PLAIN_FROM, SPM_BELOW = 90, 20           # h3 % 100 and h4 % 100


class PieceTable:
    """Descriptors over immutable buffers; code points are the unit."""

    def __init__(self, buffers: tuple[str, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: str) -> "PieceTable":
        return cls((text, SENTINELS), [(TEXT, 0, len(text))])

    def cut(self, *places: int) -> "PieceTable":
        """Split so that a piece border lies at each place (rising, repeats give
        empty pieces): k places make k + 1 pieces of a table of one."""
        (buf, start, length), = self.pieces
        edges = [0, *places, length]
        return PieceTable(self.buffers, [(buf, start + a, b - a) for a, b in zip(edges, edges[1:])])

    def permute(self, order: tuple[int, ...]) -> "PieceTable":
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def inverse(self, order: tuple[int, ...]) -> "PieceTable":
        """Undo ``permute(order)``."""
        out = [None] * len(order)
        for piece, i in zip(self.pieces, order):
            out[i] = piece
        return PieceTable(self.buffers, out)

    def marked(self, marks: list[str]) -> "PieceTable":
        """A sentinel descriptor before each piece."""
        out = []
        for piece, mark in zip(self.pieces, marks):
            out += [(SENTINEL, SENTINELS.index(mark), len(mark)), piece]
        return PieceTable(self.buffers, out)

    def stream(self) -> Iterator[str]:
        for buf, start, length in self.pieces:
            yield self.buffers[buf][start:start + length]

    def text(self) -> str:
        return "".join(self.stream())

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part.encode())
        return h.hexdigest()


def plan(key: int | None, text: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a document; the hash of
    a null key is that of ``1:``."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    n = len(text) + 1
    a, b = sorted((h1 % n, h2 % n))
    return "spm" if h4 % 100 < SPM_BELOW else "psm", a, b


def arrange(text: str, form: str, a: int, b: int) -> PieceTable:
    """The sequence of a form as descriptors."""
    t = PieceTable.of(text)
    if form == "plain":
        return t
    order = FORMS[form]
    return t.cut(a, b).permute(order).marked([MARKS[i] for i in order])


def parse(sequence: str, form: str) -> PieceTable:
    """Descriptors over the rendered ``sequence`` that spell the document again.

    No piece holds a sentinel, and one cannot arise across a border (it would
    have to begin inside another one), so each is found at its first place."""
    if form == "plain":
        return PieceTable((sequence,), [(0, 0, len(sequence))])
    order, pieces, at = FORMS[form], [], 0
    for i, nxt in zip(order, (*order[1:], None)):
        at += len(MARKS[i])
        end = len(sequence) if nxt is None else sequence.index(MARKS[nxt], at)
        pieces.append((0, at, end - at))
        at = end
    return PieceTable((sequence,), pieces).inverse(order)


def restore(sequence: str, form: str) -> str:
    return parse(sequence, form).text()


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", outputs: bool = False) -> DataFrame:
    """One row per input row: ``key``, n (code points), form, prefix_chars,
    middle_chars, output_sha256, restored_sha256; with ``outputs`` also output
    (the sequence) and pieces (its descriptors: buffer 0 the text, 1 the
    sentinels, start, length).

    Null text counts as empty; an empty text, and one that holds a sentinel,
    stays plain (lengths null). Rows are judged one by one: repeated rows give
    repeated results, and rows that share a key share its hash. Other columns
    are not read.
    """
    def run(frames):
        for f in frames:
            out = []
            for i, z, t in zip(f["id"].tolist(), f["z"].tolist(), f["t"]):
                t = t or ""
                form, a, b = plan(None if z else i, t)
                table = arrange(t, form, a, b)
                sequence = table.text()
                row = (i, z, len(t), form, *((None, None) if form == "plain" else (a, b - a)),
                       table.sha256(), parse(sequence, form).sha256())
                out.append((*row, sequence, table.pieces) if outputs else row)
            yield pd.DataFrame(out, columns=names, dtype=object)

    schema = ("id long, z boolean, n long, form string, prefix_chars long, middle_chars long, "
              "output_sha256 string, restored_sha256 string")
    if outputs:
        schema += ", output string, pieces array<struct<buffer: int, start: int, length: int>>"
    names = [c.split()[0] for c in schema.replace("array<struct<buffer: int, start: int, length: int>>", "x").split(", ")]
    rows = docs.select(*ids(key), F.col(text).alias("t")).mapInPandas(run, schema)
    return rows.select(back(key), *names[2:])
