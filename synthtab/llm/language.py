"""Languages of a document as a mixture: expectation-maximisation over words, sets of languages by penalised likelihood.

A word's likelihood in a language is the product of its letter trigrams'.  A
document's words come from languages in unknown proportions, which EM
estimates.  Sets of its 1, 2, 3 ... strongest languages are compared by
likelihood less a penalty for each further proportion; a set grows while that
helps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthtab.llm.common import free_name, slices, texts
from synthtab.llm.shingles import mix

BUCKETS = 1 << 16
SLICE = 1 << 19
ROUNDS = 6
#: Trigrams of a language are counted with this many more for every bucket.
SMOOTHING = 0.1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, first letter of each word, first word of each text."""
    text = "\n".join(batch).lower()
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    code = np.where(letters()[np.minimum(code, 0x10FFFF)], code, 0).astype(np.uint64)
    at = np.flatnonzero(code)
    padded = np.concatenate([[0], code, [0]]).astype(np.uint64)
    joined = (padded[at] << np.uint64(42)) | (padded[at + 1] << np.uint64(21)) | padded[at + 2]
    bucket = (mix(joined) >> np.uint64(48)).astype(np.int64)
    word = np.flatnonzero(np.diff(at, prepend=-5) > 1)
    # Lower-casing can lengthen a text, so its end is found in what was lower-cased.
    sizes = np.fromiter((len(x.lower()) for x in batch), np.int64, len(batch))
    begin = np.cumsum(sizes + 1) - sizes - 1
    return bucket, word, np.searchsorted(at[word], begin)


class Model:
    def __init__(self, languages: list[str], log: np.ndarray):
        self.languages, self.log = languages, log

    def predict(self, batch: list[str]) -> tuple[list[str], list[float], list[list[str]]]:
        """Language, its share of the words within the chosen set, and that set, for each text.

        Of equal shares the first language by name counts.  Texts without a
        letter, and all texts where nothing was learned, are ``und`` with
        share 0 and an empty set; a text is read whole, whatever its length.
        """
        bucket, word, first = trigrams(batch)
        name, score, chosen = ["und"] * len(batch), [0.0] * len(batch), [[] for _ in batch]
        if not len(word) or not self.languages:
            return name, score, chosen
        value = np.add.reduceat(self.log[bucket], word, axis=0)
        top = value.max(axis=1, keepdims=True)
        like = np.exp(value - top)
        words = np.diff(np.append(first, len(word)))
        docs = np.flatnonzero(words)
        words, starts = words[docs], first[docs]
        n = len(self.languages)
        share = np.full((len(docs), n), 1 / n)
        share, _ = fit(like, starts, words, share)
        order = np.argsort(-share, axis=1, kind="stable")
        best = -np.add.reduceat(top[:, 0] - np.take_along_axis(value, np.repeat(order[:, :1], words, axis=0), 1)[:, 0], starts)
        kept, size, active = np.zeros_like(share), np.ones(len(docs), np.int64), np.arange(len(docs))
        kept[np.arange(len(docs)), order[:, 0]] = 1
        for k in range(2, n + 1):
            mask = np.zeros((len(active), n), bool)
            np.put_along_axis(mask, order[active, :k], True, 1)
            rows = np.repeat(starts[active] - np.cumsum(words[active]) + words[active], words[active]) + np.arange(words[active].sum())
            begin = np.cumsum(words[active]) - words[active]
            start = np.where(mask, share[active] + 1e-6, 0)
            fitted, total = fit(like[rows], begin, words[active], start / start.sum(axis=1, keepdims=True))
            total -= 0.5 * (k - 1) * np.log(words[active] + 1.0) + np.log(n) * (k - 1)
            better = total > best[active]
            active, fitted, total = active[better], fitted[better], total[better]
            kept[active], best[active], size[active] = fitted, total, k
            if not len(active):
                break
        winner = kept.argmax(axis=1)
        for i, doc in enumerate(docs.tolist()):
            name[doc] = self.languages[winner[i]]
            score[doc] = float(min(1.0, max(0.0, kept[i, winner[i]])))
            chosen[doc] = [self.languages[j] for j in order[i, : size[i]] if kept[i, j] > 0]
        return name, score, chosen


def fit(like: np.ndarray, starts: np.ndarray, words: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after EM, and the log-likelihood of each document under them (less that of its words' best languages)."""
    for _ in range(ROUNDS):
        part = like * np.repeat(share, words, axis=0)
        part /= part.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(part, starts, axis=0) / words[:, None]
    total = (like * np.repeat(share, words, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(total + 1e-300), starts)


def train(docs: DataFrame) -> Model:
    """Trigram counts of every labelled text (non-null ``lang`` and ``text``).

    Repeated rows count as often as they stand; languages are kept in the order
    of their names; without labelled rows nothing is learned.  What reaches the driver is one row for each language and bucket: bounded by
    the languages, whatever the number of documents.
    """
    labelled = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                lang = np.array(batch.column("lang").to_pylist(), object)
                text = [x.decode("utf-8", "replace") for x in batch.column("text").to_pylist()]
                for name in dict.fromkeys(lang.tolist()):
                    bucket = trigrams([t for t, own in zip(text, lang == name) if own])[0]
                    seen = np.bincount(bucket, minlength=BUCKETS)
                    total[name] = total.get(name, 0) + seen
        for name, counts in total.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(counts[bucket])], ["lang", "bucket", "n"])

    counts = labelled.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow().to_pydict()
    languages = sorted(set(rows["lang"]))
    place = {name: i for i, name in enumerate(languages)}
    table = np.zeros((BUCKETS, len(languages)))
    table[rows["bucket"], [place[x] for x in rows["lang"]]] = rows["n"]
    table += SMOOTHING
    return Model(languages, np.log(table / table.sum(axis=0, keepdims=True)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for every whole text, one narrow pass.

    ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned.  ``score`` is the language's share of the words
    within the chosen set, ``languages`` that set, strongest first.  Repeated rows and null ids
    give a row each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log))  # languages x 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = model.predict([x.decode("utf-8", "replace") for x in batch.column("text").to_pylist()])
                kinds = pa.string(), pa.float64(), pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, kinds))], ["doc_id", "lang_pred", "score", "languages"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def keep_documents(docs: DataFrame, model: Model, least_share: float) -> DataFrame:
    """Rows of ``docs`` (all columns) whose language holds ``least_share`` of the words; ``und`` goes.

    A narrow pass: the rows travel through the workers, so nothing is joined back.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log))
    schema, extra = docs.schema, free_name(docs, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for whole in batches:
            body = whole.append_column(extra, whole.column("text").cast(pa.binary()).fill_null(b""))
            for batch in slices(body, extra, SLICE):
                name, score, _ = model.predict([x.decode("utf-8", "replace") for x in batch.column(extra).to_pylist()])
                keep = [n != "und" and s >= least_share for n, s in zip(name, score)]
                yield whole.slice(0, 0) if not any(keep) else batch.select(whole.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
