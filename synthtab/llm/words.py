"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

A tokenizer that drops white space gives a text the ids of its words one after
the other: no pre-token crosses white space, and composition and lower-casing
do not either.  So every distinct word needs the library once in a while, and
a text is a join of byte strings.  Other tokenizers get the whole text.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import regex

#: Words remembered by one Python worker, and the longest of them in bytes.
WORDS_KEPT = 400_000
LONGEST_KEPT = 64


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


def keep(memory: dict, key, value):
    """Remember a short key; a full memory forgets its later half, as frequent words come early."""
    if len(key) <= LONGEST_KEPT:
        if len(memory) >= WORDS_KEPT:
            for _ in range(WORDS_KEPT // 2):
                memory.popitem()
        memory[key] = value
    return value


class PieceIds(dict):
    """Lower-case Latin pre-token to its ids."""

    def __init__(self, model, kind: str):
        super().__init__()
        self._model, self._kind, self._as_bytes = model, kind, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._as_bytes)
        return keep(self, piece, np.array([t.id for t in self._model.tokenize(text)], self._kind).tobytes())


class WordIds(dict):
    """Word (bytes without ASCII white space) to its ids as little-endian unsigned integers."""

    def __init__(self, tokenizer, kind: str = "<u4"):
        super().__init__()
        self._whole, self._kind = tokenizer, kind
        self._model, self._normal, self._split = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # Printable Latin words under U+0250 are composed as they stand (no combining marks) and have no white space,
        # so lower-casing and the tokenizer's own pattern give their pre-tokens: the library's slow parts are not needed.
        steps = json.loads(tokenizer.to_str())
        latin = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        parts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        latin &= not any(x.rstrip(".,;:!?").isalpha() for x in self._special)
        latin &= [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed"
        self._pieces = regex.compile(parts[0]["pattern"]["Regex"]).findall if latin else None
        self._piece = PieceIds(tokenizer.model, kind)
        one = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = all(one(f" {a}\n{b}\t") == one(a) + one(b) for a, b in (("a", "b"), ("it's", "é."), ("1", "<")))

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self._pieces and (text.isascii() or max(text) < "\u0250"):
            low = text.lower()
            stem = low.rstrip(".,;:!?")
            if stem.isalpha():
                end = low[len(stem) :]
                return keep(self, word, self._piece[stem] + self._piece[end] if end else self._piece[stem])
            if low.isprintable() and not any(x in text for x in self._special):
                return keep(self, word, b"".join(map(self._piece.__getitem__, self._pieces(low))))
        if any(x in text for x in self._special):
            ids = self._whole.encode(text, add_special_tokens=False).ids
        else:
            pieces = self._split.pre_tokenize_str(self._normal.normalize_str(text))
            ids = [t.id for piece, _ in pieces for t in self._model.tokenize(piece)]
        return keep(self, word, np.array(ids, dtype=self._kind).tobytes())

    def text(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        if self.by_word:
            return b"".join(map(self.__getitem__, text.split()))
        ids = self._whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype=self._kind).tobytes()


@lru_cache(maxsize=4)
def word_ids(path: str, kind: str = "<u4") -> WordIds:
    """One for each Python worker: it lives as long as the worker is used again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path), kind)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
