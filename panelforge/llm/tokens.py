"""Token ids of a public word-level BPE, with a bounded cache of words.

The tokenizer cuts at white space before anything else, so a text's ids are
the ids of its words in a row. Words are looked up as bytes of little-endian
32-bit ids; a text is one ``join`` over the cache. Words of plain letters,
digits and marks are cut into the tokenizer's pieces and only unknown pieces
reach its model; every other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

from panelforge.llm.common import claim

WORDS_KEPT = 300_000    # entries of the caches; a full cache starts again
PIECES_KEPT = 200_000

# Words made of these only: printable ASCII but the apostrophe, and the
# letters of Latin-1. Their pieces are letters, single digits, runs of marks.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def tokenizer_file(tokenizer: str) -> str:
    """A path as given, or the name of a file of the public tokenizers."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


class WordIds:
    """Ids of texts by one tokenizer file (a ``tokenizers`` JSON that drops
    white space and lower-cases)."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_file(tokenizer))
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # how the tokenizer spells the letters of Latin-1 to its model
        self.spelt = {cp: self.tok.pre_tokenizer.pre_tokenize_str(chr(cp))[0][0]
                      for cp in range(0xDF, 0x100) if cp != 0xF7}

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= PIECES_KEPT:
            self.pieces.clear()
        mapped = piece if piece.isascii() else piece.translate(self.spelt)
        got = np.array([t.id for t in self.tok.model.tokenize(mapped)], dtype="<u4").tobytes()
        self.pieces[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not ("<" in word and any(s in word for s in self.special)):
            parts = _PIECE.findall(word.lower())
            return b"".join([self.pieces.get(p) or self._piece(p) for p in parts])
        ids = self.tok.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text, 4 bytes each, little-endian."""
        if not text:
            return b""
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        words = text.split(" ")
        cache = self.words
        if len(cache) >= WORDS_KEPT:
            cache.clear()
        got = list(map(cache.get, words))
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    w = words[i]
                    g = cache.get(w)
                    if g is None:
                        g = cache[w] = self._word(w) if w else b""
                    got[i] = g
        return b"".join(got)


_READY: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    """One instance per Python worker, kept from task to task."""
    claim("tokens", _READY.clear)
    if tokenizer not in _READY:
        _READY[tokenizer] = WordIds(tokenizer)
    return _READY[tokenizer]
