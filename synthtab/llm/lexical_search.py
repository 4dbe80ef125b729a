"""Ranked lexical search: accumulators for short lists, bounded iterators that skip over long ones.

The items are the queries.  Documents keep the frequencies of those terms that
some item asks for.  A task turns its documents into segments with one list a
term, in document order.  For an item the lists with few documents are summed
term at a time; what comes of it is one more list, with its largest sum as its
bound.  That list and the long ones are then passed document at a time, window
by window: a window whose bounds cannot reach the tenth score is skipped, only
lists without which that score is out of reach give candidates, and the others
are looked up for candidates alone, as long as these can still reach it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, slices, texts, write_stage

TOP = 10
#: Bytes of items searched for in one pass over the documents, about.
ITEM_BYTES = 1 << 20
SLICE = 4 << 20
#: Documents and list entries of a segment, documents of a window.
SEGMENT_DOCS = 1 << 15
SEGMENT_ENTRIES = 3 << 19
WINDOW = 1 << 11
#: A list with one document in so many is short.
SHORT = 16
#: Groups in which results of many tasks are cut down before the last ranking.
SPREAD = 64
#: What ends a term: ASCII but letters and digits.  Other bytes stand for themselves, A-Z for a-z.
TURN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased."""
    return text.translate(TURN).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def frequencies(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: how many terms each document has, and the frequencies of the numbered ones."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                n, ends, terms, tfs = [], [0], [], []
                for text in batch.column("text").to_pylist():
                    words = terms_of(text)
                    count = Counter(words)
                    asked = count.keys() & known.keys()
                    n.append(len(words))
                    terms.extend([known[t] for t in asked])
                    tfs.extend([count[t] for t in asked])
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` numbered terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for row in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


class Segment:
    """Lists of some documents: for each term their places, ascending, and what the term adds to their scores."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, place: np.ndarray, lengths: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(lengths)
        scale = 10 + 90 * lengths * n_docs // n_terms
        adds = weight[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * scale[place]))
        order = np.argsort(terms, kind="stable")
        self.place, self.adds = place[order], adds[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.windows = -(-self.size // WINDOW)
        cell = terms[order].astype(np.int64) * self.windows + self.place // WINDOW
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        #: The most that a list adds in each window.
        self.most = np.zeros((len(weight), self.windows), np.int64)
        if len(cell):
            self.most.reshape(-1)[cell[first]] = np.maximum.reduceat(self.adds, first)

    def lists(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, scores, most by window) of an item: summed short lists as one, and the long ones."""
        short, out = [], []
        for t in wanted.tolist():
            part = slice(self.starts[t], self.starts[t + 1])
            one = self.place[part], self.adds[part], self.most[t]
            if part.stop - part.start > self.size // SHORT:
                out.append(one)
            elif part.stop > part.start:
                short.append(one)
        if short:
            places, at = np.unique(np.concatenate([p for p, _, _ in short]), return_inverse=True)
            sums = np.zeros(len(places), np.int64)
            np.add.at(sums, at, np.concatenate([s for _, s, _ in short]))
            most = np.zeros(self.windows, np.int64)
            np.maximum.at(most, places // WINDOW, sums)
            out.append((places, sums, most))
        return out

    def search(self, wanted: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the ``top`` with a score of ``least`` or more."""
        lists = self.lists(wanted)
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = sum(m for _, _, m in lists)
        found, scores, best = [], [], np.zeros(0, np.int64)
        for w in np.flatnonzero(reach >= least).tolist():
            if reach[w] < least:
                continue  # the tenth score has risen
            low = w * WINDOW
            here = sorted((x for x in lists if x[2][w]), key=lambda x: -x[2][w])
            # rest[j]: what the lists from j on can add.
            rest = np.append(np.cumsum([x[2][w] for x in reversed(here)])[::-1], 0)
            giving = int((rest[:-1] >= least).sum())
            cuts = [np.searchsorted(p, [low, low + WINDOW]) for p, _, _ in here]
            score = np.zeros(min(WINDOW, self.size - low), np.int64)
            for (p, s, _), (a, b) in zip(here[:giving], cuts):
                score[p[a:b] - low] += s[a:b]
            at = np.flatnonzero((score > 0) & (score + rest[giving] >= least))
            for j in range(giving, len(here)):
                p, s, _ = here[j]
                a, b = cuts[j]
                hit = np.minimum(np.searchsorted(p[a:b], at + low), b - a - 1)
                has = p[a:b][hit] == at + low
                score[at[has]] += s[a:b][hit[has]]
                at = at[score[at] + rest[j + 1] >= least]
            if len(at):
                found.append(at + low)
                scores.append(score[at])
                best = np.sort(np.concatenate([best, score[at]]))[-top:]
                if len(best) == top:
                    least = max(least, int(best[0]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, values = np.concatenate(found), np.concatenate(scores)
        first = np.lexsort((places, -values))[:top]  # places follow the ids
        return places[first], values[first]


def best_of_tasks(rows: DataFrame, items: dict[int, np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item_no, doc_id, score``: the ``top`` of each task for each item."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: dict[int, list[tuple[int, bool, int]]] = {}
        held: list[pa.RecordBatch] = []

        def searched() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            # Null ids come last.
            table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
            terms = table.column("terms").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int32()))
            tfs = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            place = np.repeat(np.arange(len(terms)), pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))
            segment = Segment(terms.flatten().to_numpy(), tfs, place, table.column("n").to_numpy(), weight, n_docs, n_terms)
            ids = table.column("doc_id").to_pylist()
            for number, wanted in asked.items():
                mine = best.get(number, [])
                least = -mine[-1][0] if len(mine) == top else 1
                places, values = segment.search(wanted, least, top)
                if len(places):
                    new = [(-v, ids[p] is None, ids[p] or 0) for p, v in zip(places.tolist(), values.tolist())]
                    best[number] = sorted(mine + new)[:top]

        size = entries = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SEGMENT_DOCS):
                part = batch.slice(start, SEGMENT_DOCS)
                held.append(part)
                size, entries = size + part.num_rows, entries + len(part.column("terms").flatten())
                if size >= SEGMENT_DOCS or entries >= SEGMENT_ENTRIES:
                    searched()
                    size = entries = 0
        if held:
            searched()
        found = [(number, None if null else doc, -score) for number, docs in best.items() for score, null, doc in docs]
        numbers, docs, scores = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["item_no", "doc_id", "score"])

    return rows.where("n > 0").mapInArrow(run, "item_no long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """``found`` with its rank in each item, cut to ``top`` in two steps, as every task has found as many."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item_no", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_no").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above 0 for each item.

    Equal scores stand in the order of doc_id, null last.  Every row of
    ``items`` is an item of its own, every row of ``docs`` a document; null
    texts have no terms, and items without terms or without a match no rows.
    Items are searched for in blocks of about ``item_bytes``, each in one pass
    over the documents; only one block is in the driver at a time.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    asked, asked_path = write_stage(items.select("item_id", text.alias("text")), "search-items")
    asked, numbered_path = write_stage(asked.withColumn("item_no", F.monotonically_increasing_id()), "search-items")
    drop_stage(spark, asked_path)
    blocks = max(1, ceil(2 * (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / item_bytes))
    parts = []
    for block in range(blocks):
        wanted = {r["item_no"]: set(terms_of(bytes(r["text"]))) for r in asked.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block).collect()}
        numbers = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
        rows, path = write_stage(frequencies(docs, numbers), "search-frequencies")
        n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        weight = weights(document_counts(rows, len(numbers)), n_docs)
        by_number = {i: np.array(sorted(numbers[t] for t in terms), np.int64) for i, terms in wanted.items()}
        best = best_of_tasks(rows, by_number, weight, n_docs, n_terms or 1, top)
        parts.append(write_stage(ranked(best, top), "search-found")[0])
        drop_stage(spark, path)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
