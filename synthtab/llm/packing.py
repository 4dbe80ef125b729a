"""Packing by harmonic classes: bins of a class hold a fixed number of pieces, gaps take cut text.

A document gives full sequences and a remainder.  A remainder of more than
C/(k+1) and at most C/k tokens belongs to class k, whose bins hold exactly k of
them.  The room that a bin leaves is filled with cuts of a few of the longest
documents, so only the last sequence of a pool is padded.  Pools are parts of
a task's input, so workers never speak to each other and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from synthtab.llm.common import texts
from synthtab.llm.words import word_ids

#: Tokens packed together by a worker: its memory is bounded, its padding at most one sequence.
POOL = 1 << 23


def fill_classes(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the tokens in each bin; a class that runs short takes what is left of it."""
    kind = capacity // lengths
    order = np.lexsort((-lengths, kind))
    sorted_kind = kind[order]
    first = np.searchsorted(sorted_kind, sorted_kind)
    place = np.arange(len(order)) - first
    opens = place % sorted_kind == 0
    bins = np.cumsum(opens) - 1
    before = np.cumsum(lengths[order]) - lengths[order]
    offset = before - np.repeat(before[opens], np.diff(np.append(np.flatnonzero(opens), len(order))))
    bin_of, offset_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    bin_of[order], offset_of[order] = bins, offset
    used = np.bincount(bins, weights=lengths[order]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    return bin_of, offset_of, used


def pack_lengths(lengths: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces ``doc, start, length, sequence, offset`` of documents with ``lengths`` tokens."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    rest = lengths % capacity

    def room(fillers: int) -> int:
        """Room that the classes leave when the longest ``fillers`` documents are cut freely, less what those hold."""
        kept = rest[order[fillers:]]
        used = fill_classes(kept[kept > 0], capacity)[2]
        return int((capacity - used).sum() - lengths[order[:fillers]].sum())

    low, high = 0, len(order)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if room(middle) <= 0 else (middle + 1, high)
    cut, whole = order[:low], order[low:]
    # Full sequences of the documents that are not cut freely.
    full = lengths[whole] // capacity
    doc = np.repeat(whole, full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * capacity
    out = [(doc, start, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    ends = whole[rest[whole] > 0]
    bins, offset, used = fill_classes(rest[ends], capacity)
    out.append((ends, lengths[ends] - rest[ends], rest[ends], bins + len(doc), offset))
    # The cut documents as one stream, laid over the gaps and then over new sequences.
    stream = int(lengths[cut].sum())
    gaps = capacity - used
    more = max(0, -(-(stream - int(gaps.sum())) // capacity))
    gap_size = np.append(gaps, np.full(more, capacity))
    gap_sequence = np.arange(len(gap_size)) + len(doc)
    gap_offset = np.append(used, np.zeros(more, np.int64))
    edge = np.append(0, np.cumsum(gap_size))
    doc_edge = np.append(0, np.cumsum(lengths[cut]))
    marks = np.unique(np.concatenate([edge[edge < stream], doc_edge]))
    at, size = marks[:-1], np.diff(marks)
    of_doc = np.searchsorted(doc_edge, at, "right") - 1
    of_gap = np.searchsorted(edge, at, "right") - 1
    out.append((cut[of_doc], at - doc_edge[of_doc], size, gap_sequence[of_gap], gap_offset[of_gap] + at - edge[of_gap]))
    names = ("doc", "start", "length", "sequence", "offset")
    return {name: np.concatenate([x[i] for x in out]) for i, name in enumerate(names)}


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document in its sequence.

    Ids are those of the tokenizers library with ``end_id`` after each
    document, so a null or empty text is one token.  Repeated rows are packed
    each; null ids stay null; an empty table gives no rows.  ``with_ids`` adds
    the ids of a piece as little-endian unsigned 32-bit integers.
    """

    def pieces(ids: list[int], held: list[bytes], task: int, first: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        found = pack_lengths(sizes, capacity)
        docs_, starts, lengths = (found[x].tolist() for x in ("doc", "start", "length"))
        bodies = [memoryview(held[d])[4 * s : 4 * (s + n)] for d, s, n in zip(docs_, starts, lengths)]
        sequence = found["sequence"] + first + (task << 36)
        columns = [
            pa.array([ids[d] for d in docs_], pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
            pa.array(map(zlib.crc32, bodies), pa.int64()), pa.array(sizes[found["doc"]]), pa.array(sequence),
            pa.array(found["offset"]),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([bytes(x) for x in bodies], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), first + int(found["sequence"].max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path, "<u4"), np.array([end_id], "<u4").tobytes()
        task, first, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                body = encode.text(text.as_py()) + end
                ids.append(doc_id)
                held.append(body)
                size += len(body) // 4
                if size >= pool:
                    out, first = pieces(ids, held, task, first)
                    ids, held, size = [], [], 0
                    yield out
        if ids:
            yield pieces(ids, held, task, first)[0]

    return texts(docs).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
