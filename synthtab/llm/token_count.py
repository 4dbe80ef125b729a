"""Token counts: byte-pair merges of many words at once, one merge rank of every word in each round.

Words of a batch become one ragged array of symbols.  A round looks up the
rank of every adjacent pair, takes the lowest of each word, merges all its
occurrences in all words together, and retires words without a known pair.
What remains of a word is its tokens; nothing is tokenised by a library.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthtab.llm.common import slices, texts
from synthtab.llm.words import WORDS_KEPT, byte_characters

#: Bytes of text, and of new words, that are in work at once.
SLICE = 16 << 20
WORD_SLICE = 4 << 20
NO_RANK = np.int64(1 << 60)


class Merges:
    """A byte-level merge table with a word-end suffix, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        kinds = [x["type"] for x in spec["normalizer"].get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("only lower-case byte-level vocabularies that drop white space are supported")
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        names = byte_characters()
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        rank = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            rank.setdefault(vocab[a] * self.size + vocab[b], (n, vocab[a + b]))
        self.pairs = np.array(sorted(rank), np.int64)
        self.ranks = np.array([rank[x][0] for x in self.pairs.tolist()], np.int64)
        self.made = np.array([rank[x][1] for x in self.pairs.tolist()], np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each pre-token (at least one byte each)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        row = np.repeat(np.arange(len(words)), size)
        left = size.copy()
        while len(symbol) > 1:
            pair = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = (self.pairs[at] == pair) & (row[:-1] == row[1:])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(row)))
            hit = (rank == np.repeat(lowest, lengths)) & (rank < NO_RANK)
            if not hit.any():
                break
            first = np.flatnonzero(hit)
            # A run of hits is one symbol repeated: its pairs overlap, every second one counts from the left.
            run = np.append(True, np.diff(first) > 1)
            place = np.arange(len(first))
            first = first[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbol[first] = self.made[at[first]]
            stay = np.repeat(lowest < NO_RANK, lengths)
            stay[first + 1] = False
            left -= np.bincount(row[first], minlength=len(left))
            symbol, row = symbol[stay], row[stay]
        return left

    def words(self, words: list[bytes]) -> list[int]:
        """Tokens of words without ASCII white space, special strings counted as one token each."""
        tokens, rows, found = [0] * len(words), [], []
        for n, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            parts = [text]
            if self.cut and any(x in text for x in self.special):
                parts = self.cut.split(text)
                tokens[n] += len(parts) - 1
            for part in parts:
                if not part.isascii():
                    # Single letters: a final sigma is lower-cased like any other.
                    part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                else:
                    part = part.lower()
                pieces = [part] if part.isalpha() else self.pieces(part)
                found.extend(x.encode() for x in pieces)
                rows.extend([n] * len(pieces))
        start = 0
        while start < len(found):
            stop, held = start, 0
            while stop < len(found) and (held == 0 or held + len(found[stop]) <= WORD_SLICE):
                held += len(found[stop])
                stop += 1
            for n, k in zip(rows[start:stop], self.count(found[start:stop]).tolist()):
                tokens[n] += k
            start = stop
        return tokens


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


_kept: dict[str, dict[bytes, int]] = {}


def count_batch(path: str, batch: list[bytes]) -> list[int]:
    """Tokens of each text; words seen before are remembered up to a bound."""
    table, memory = merges(path), _kept.setdefault(path, {})
    split = [text.split() for text in batch]
    new = list(set(chain.from_iterable(split)) - memory.keys())
    memory.update(zip(new, table.words(new)))
    counted = [sum(map(memory.__getitem__, words)) for words in split]
    while len(memory) > WORDS_KEPT:
        memory.popitem()  # the latest: frequent words come early
    return counted


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document, in one narrow pass.

    ``path`` is the vocabulary file, readable on every executor.  A null text
    counts as empty and has no tokens; repeated rows and null ids give a row
    each; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                text = batch.column("text").to_pylist()
                columns = [batch.column("doc_id"), pa.array(map(len, text), pa.int64()), pa.array(count_batch(path, text), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    counted = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
