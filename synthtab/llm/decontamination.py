"""Benchmark passages in documents, up to a share of edited words.

Texts are words: lower case, punctuation, symbols and white space aside; in
scripts without spaces every character is a word.  A CGK
embedding walks over the words of a string with shared random bits, copying
the word it stands on and moving on or staying by the bit for that word and
step; strings at a small edit distance meet again after each edit, so their
embeddings differ in few places (Hamming).  Windows of an item's size are
embedded, sampled in ``TABLES`` sets of places and looked up among the items'
samples; candidates are confirmed by the exact edit distance of the words.

With at most ``e`` edits an item of ``n`` words keeps a run of
``(n - e) / (e + 1)`` words, so only windows over a run of that many words of
the item are embedded: that loses no pair.  Items of fewer than eight words
allow no edits, and are found as runs of equal words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthtab.llm.common import free_name, slices, texts, write_stage
from synthtab.llm.shingles import constants, mix, word_hashes

SLICE = 1 << 20
#: One word in so many may be edited.
WORDS_PER_EDIT = 8
#: Items of fewer words stand in texts by chance; ``skipped_items`` names them.
MIN_WORDS = 3
WALKS, TABLES_PER_WALK, SAMPLES = 8, 4, 3
#: Bytes of items searched for in one pass over the documents.
ITEM_BYTES = 32 << 20
BITMAP = 20
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Characters that are neither ASCII nor Latin letters; among them those that part words, and those that are words.
OTHER = re.compile("[\x80-\xbf\xd7\xf7\u0250-\U0010ffff]")
PARTING = regex.compile(r"[^\P{P}\x00-\x7f]|[^\P{S}\x00-\x7f]|[^\P{Z}\x00-\x7f]|[^\P{Cc}\x00-\x7f]")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def plain(text: bytes) -> bytes:
    """The words of a text, parted by blanks."""
    lower = text.decode("utf-8", "replace").lower()
    if OTHER.search(lower):
        lower = UNSPACED.sub(r" \g<0> ", PARTING.sub(" ", lower))
    return lower.encode().translate(PLAIN)


def words_of(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts together, and the first word of each text."""
    plain_ = [plain(t) for t in texts_]
    hashes, start, _ = word_hashes(b"\n".join(plain_))
    sizes = np.fromiter(map(len, plain_), np.int64, len(plain_))
    return hashes, np.searchsorted(start, np.cumsum(sizes + 1) - sizes - 1)


def runs_of(hashes: np.ndarray, q: int) -> np.ndarray:
    """A hash for each ``q`` words in a row."""
    if len(hashes) < q:
        return np.zeros(0, np.uint64)
    factor = constants(q, 601)
    return mix(sum(hashes[j : len(hashes) - q + 1 + j] * factor[j] for j in range(q)))


def embed(strings: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding, three times as long, of equally long strings (one in each row)."""
    rows, n = strings.shape
    padded = np.concatenate([strings, np.zeros((rows, 1), np.uint64)], axis=1)
    turn = constants(3 * n, 701 + walk)
    at, every, out = np.zeros(rows, np.int64), np.arange(rows), np.empty((rows, 3 * n), np.uint64)
    for j in range(3 * n):
        symbol = padded[every, at]
        out[:, j] = symbol
        at = np.minimum(at + (((symbol ^ turn[j]) * turn[j]) >> np.uint64(63)).astype(np.int64), n)
    return out


def sample_keys(strings: np.ndarray) -> Iterator[np.ndarray]:
    """One key for each string, table by table."""
    n = strings.shape[1]
    for walk in range(WALKS):
        embedded = embed(strings, walk)
        for table in range(TABLES_PER_WALK):
            factor = constants(SAMPLES, 809 + walk * TABLES_PER_WALK + table)
            # Places in the first two thirds: later ones are often past the end of the string.
            places = (factor >> np.uint64(20)) % np.uint64(max(1, 2 * n))
            yield mix(sum(embedded[:, p] * f for p, f in zip(places.astype(np.int64), factor)))


def last_row(item: np.ndarray, text: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Edit distances of ``item`` to the parts of ``text`` that end at each place; ``row``: the cost of beginning there."""
    step = np.arange(len(text) + 1)
    for i, word in enumerate(item.tolist(), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (text != np.uint64(word)))
        row = np.minimum.accumulate(np.append(row[0] + 1, new) - step) + step
    return row


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to a part of ``text``, and where that part begins."""
    ends = last_row(item, text, np.zeros(len(text) + 1, np.int64))
    end = int(ends.argmin())
    back = last_row(item[::-1], text[:end][::-1], np.arange(end + 1))
    return int(ends[end]), end - int(back.argmin())


class Items:
    """Items by length, with their runs and their samples."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            self.by_length[len(w)].append(i)
        self.tables = {}
        runs: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for n, members in self.by_length.items():
            strings = np.stack([words[i] for i in members])
            tables = []
            for keys in sample_keys(strings):
                table = defaultdict(list)
                for i, key in zip(members, keys.tolist()):
                    table[key].append(i)
                tables.append(dict(table))
            self.tables[n] = tables
            edits = n // WORDS_PER_EDIT
            q = (n - edits) // (edits + 1)
            for i in members:
                runs[q].append((np.unique(runs_of(words[i], q)), n))
        self.runs = {}
        for q, found in runs.items():
            pairs = np.unique(np.stack([np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), n, np.uint64) for r, n in found])]), axis=1)
            bitmap = np.zeros(1 << BITMAP, bool)
            bitmap[pairs[0] >> np.uint64(64 - BITMAP)] = True
            self.runs[q] = (pairs[0], pairs[1].astype(np.int64), bitmap)

    def find(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) to (edits, first word) of the best window, over texts that begin at ``first``."""
        last = np.append(first[1:], len(hashes))
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for q, (keys, lengths, bitmap) in self.runs.items():
            runs = runs_of(hashes, q)
            at = np.flatnonzero(bitmap[runs >> np.uint64(64 - BITMAP)])
            low, high = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            while (more := low < high).any():
                at, low, high = at[more], low[more], high[more]
                for n in np.unique(lengths[low]).tolist():
                    own = at[lengths[low] == n]
                    # Edits before the run can shift the window's start.
                    reach = np.arange(-(n - q) - n // WORDS_PER_EDIT, n // WORDS_PER_EDIT + 1)
                    starts[n].append(np.unique(own[:, None] + reach))
                low = low + 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, found in starts.items():
            start = np.unique(np.concatenate(found))
            start = start[(start >= 0) & (start < len(hashes))]
            doc = np.searchsorted(first, start, "right") - 1
            # A window at a text's edge keeps inside it: the item may have lost its first or last words.
            start = np.unique(np.maximum(np.minimum(start, last[doc] - n), first[doc]))
            doc = np.searchsorted(first, start, "right") - 1
            size = np.minimum(n, last[doc] - start)
            keep = size >= n - n // WORDS_PER_EDIT
            start, doc, size = start[keep], doc[keep], size[keep]
            for part in range(0, len(start), 20_000):
                self._windows(hashes, n, start[part : part + 20_000], doc[part : part + 20_000], size[part : part + 20_000], first, last, best)
        return best

    def _windows(self, hashes, n, start, doc, size, first, last, best) -> None:
        place = start[:, None] + np.arange(n)
        inside = np.arange(n) < size[:, None]
        strings = np.where(inside, hashes[np.minimum(place, len(hashes) - 1)], np.uint64(0))
        asked: dict[tuple[int, int], set[int]] = defaultdict(set)
        for table, keys in zip(self.tables[n], sample_keys(strings)):
            known = np.flatnonzero(np.isin(keys, np.fromiter(table, np.uint64, len(table))))
            for k in known.tolist():
                for i in table[int(keys[k])]:
                    asked[int(doc[k]), i].add(int(start[k]))
        most = n // WORDS_PER_EDIT
        for pair, begins in asked.items():
            # Windows that overlap are confirmed together: the item against all that they cover, and the edits more.
            begins = np.array(sorted(begins))
            text_first, text_last = first[pair[0]], last[pair[0]]
            for group in np.split(begins, np.flatnonzero(np.diff(begins) > n) + 1):
                low, high = max(text_first, group[0] - most), min(text_last, group[-1] + n + most)
                edits, begin = closest(self.words[pair[1]], hashes[low:high])
                if edits <= most:
                    best[pair] = min(best.get(pair, (most + 1, 0)), (edits, int(low) + begin))


def item_blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items, in blocks of bounded size; a benchmark of any size is searched for block by block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.where("item_id is not null and text is not null")
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], bytes(row["text"])))
        held += len(row["text"])
        if held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


#: The items that this Python process has searched for last, by their block.
_ready: dict[int, Items] = {}


def ready(shared: Broadcast) -> Items:
    """The tables of a block, made once for each Python worker and not for each task."""
    number, ids, words = shared.value
    if number not in _ready:
        _ready.clear()
        _ready[number] = Items(ids, words)
    return _ready[number]


def share(docs: DataFrame, block: list[tuple[int, bytes]]) -> Broadcast:
    ids, words = long_enough(block)  # a block: bounded by its bytes
    return docs.sparkSession.sparkContext.broadcast((uuid4().int, ids, words))


def contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, item_id, edits, first_word, n_words``: each item found in each document, at its best place.

    Of equally good places the first counts.  Items of fewer than
    ``MIN_WORDS`` words (null and empty ones too) are never found, see
    ``skipped_items``; null and empty documents hold nothing; repeated rows and
    items give a row for each; without rows on either side there are none.
    Each block of items is one pass over the documents, whose result is
    staged before the next block is read.
    """
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark, item_bytes):
        shared = share(docs, block)
        found, _ = write_stage(search(docs, shared), "items-found")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows of ``docs`` (all columns) without those that hold an item.

    A narrow pass for each block of items: each row is judged by its own text,
    so null and repeated ids do not matter and nothing is joined back.  What
    is left after a block is staged if another one follows.
    """
    before: Broadcast | None = None
    for block in item_blocks(benchmark, item_bytes):
        if before is not None:
            docs, _ = write_stage(docs, "items-clean")
            before.destroy()
        before = share(docs, block)
        docs = without_items(docs, before)
    return docs


def skipped_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_words`` of the items that are too short to be searched for; null and empty texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = words_of(batch.column("text").to_pylist())
            sizes = np.diff(np.append(first, len(hashes)))
            columns = [batch.column("item_id"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "n_words"]).filter(pa.array(sizes < MIN_WORDS))

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, n_words long")


def without_items(docs: DataFrame, shared: Broadcast) -> DataFrame:
    schema, extra = docs.schema, free_name(docs, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready(shared)
        for whole in batches:
            body = whole.append_column(extra, whole.column("text").cast(pa.binary()).fill_null(b""))
            for batch in slices(body, extra, SLICE):
                found = {doc for doc, _ in items.find(*words_of(batch.column(extra).to_pylist()))}
                keep = [i not in found for i in range(batch.num_rows)]
                yield batch.select(whole.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


FOUND = "doc_id long, item_id long, edits int, first_word long, n_words int"


def long_enough(block: list[tuple[int, bytes]]) -> tuple[list[int], list[np.ndarray]]:
    """Ids and words of the items of ``MIN_WORDS`` words or more."""
    hashes, first = words_of([t for _, t in block])
    parts = np.split(hashes, first[1:])
    chosen = [i for i, w in enumerate(parts) if len(w) >= MIN_WORDS]
    return [block[i][0] for i in chosen], [parts[i] for i in chosen]


def search(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready(shared)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                hashes, first = words_of(batch.column("text").to_pylist())
                found = items.find(hashes, first)
                if found:
                    doc_ids, keys = batch.column("doc_id").to_pylist(), sorted(found)
                    columns = [
                        pa.array([doc_ids[d] for d, _ in keys], pa.int64()), pa.array([items.ids[i] for _, i in keys], pa.int64()),
                        pa.array([found[k][0] for k in keys], pa.int32()), pa.array([found[k][1] - int(first[k[0]]) for k in keys], pa.int64()),
                        pa.array([len(items.words[i]) for _, i in keys], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "first_word", "n_words"])

    return texts(docs).mapInArrow(run, FOUND)
