"""Token files: ids of all documents in doc_id order, coded in independent blocks of whole documents.

A folder holds two tables.  ``table``: the shared frequencies, one row for each
id that occurs (bounded by the vocabulary).  ``blocks``: one row for each block
with its file number, its place in the file, its documents' ids and lengths,
and the coded bytes (see ``rans``).  Blocks are rows of Parquet files, so Spark
places, retries and commits them on any store, and a reader decodes any block
alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, texts, write_stage
from synthtab.llm.rans import Table, decode, encode, scaled
from synthtab.llm.words import vocabulary_size, word_ids

FILE_IDS = 1 << 24
BLOCK_IDS = 1 << 18


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, row_no, n_tokens, ids``: ids of every whole text and the end id, little-endian, 2 or 4 bytes each."""
    kind = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path, kind), np.array([end_id], kind).tobytes()
        width = len(end)
        for batch in batches:
            ids = [words.text(x.as_py()) + end for x in batch.column("text")]
            sizes = pa.array([len(x) // width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    coded = texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")
    return coded.withColumn("row_no", F.monotonically_increasing_id()).withColumn("width", F.lit(int(kind[-1])))


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs; tasks send one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for width in set(batch.column("width").to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column("width"), width)).column("ids")
                ids = np.frombuffer(b"".join(own.to_pylist()), f"<u{width}")
                if len(ids) and ids.max() >= len(total):
                    total = np.append(total, np.zeros(int(ids.max()) + 1, np.int64))
                seen = np.bincount(ids)
                total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def read_table(rows) -> Table:
    size = max((r["id"] for r in rows), default=0) + 1
    freq = np.zeros(size, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return Table.of(freq)


BLOCK = "file_no int, block_no int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of ``docs`` under ``folder``, in ascending doc_id order (null ids first).

    A null text counts as empty (its end id alone); repeated rows are written
    each, in input order; other columns are not read; an empty table gives
    empty tables.  A document of any length lies in one block.
    """
    spark = docs.sparkSession
    tokens, stage = write_stage(tokenise(docs, path, end_id), "tokens")
    counts = id_counts(tokens).collect()  # at most the vocabulary
    freq = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        freq[r["id"]] = r["n"]
    total = int(freq.sum())
    freq = scaled(freq)
    seen = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(seen, "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, file_no = Table.of(shared.value), TaskContext.get().partitionId()
        number, start, docs_, sizes, bodies, held = 0, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            row = [[file_no], [number], [start], [held], [docs_], [sizes], [encode(np.concatenate(bodies), table)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["file_no", "block_no", "start", "n_tokens", "doc_ids", "lengths", "data"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, width, body in zip(*(batch.column(c) for c in ("doc_id", "width", "ids"))):
                ids = np.frombuffer(body.as_buffer(), f"<u{width.as_py()}")
                if held and held + len(ids) > block_ids:
                    yield block()
                    number, start, docs_, sizes, bodies, held = number + 1, start + held, [], [], [], 0
                docs_.append(doc_id.as_py())
                sizes.append(len(ids))
                bodies.append(ids)
                held += len(ids)
        if held:
            yield block()

    files = max(1, -(-total // file_ids))
    ordered = tokens.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "row_no")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_no").select("doc_id", "width", "ids")
    ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    shared.destroy()
    drop_stage(spark, stage)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, file_no`` of every document, decoded block by block.

    ``start`` counts the ids of all documents before it; ``with_ids`` adds them
    as little-endian unsigned 32-bit integers.  Damage raises an error.
    """
    freq = spark.read.schema("id long, freq long").parquet(f"{folder}/table").collect()  # at most the vocabulary
    table = read_table(freq)
    shared = spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                file_no, start, docs, sizes, data = (batch.column(c)[row] for c in ("file_no", "start", "doc_ids", "lengths", "data"))
                ids = memoryview(decode(data.as_py(), table).astype("<u4").tobytes())
                sizes = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                bodies = [ids[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                columns = [
                    pa.array(docs.as_py(), pa.int64()), pa.array(ends - sizes + start.as_py()), pa.array(sizes),
                    pa.array(map(zlib.crc32, bodies), pa.int64()), pa.array(np.full(len(sizes), file_no.as_py(), np.int32)),
                ]
                names = ["doc_id", "start_in_file", "n_tokens", "ids_crc32", "file_no"]
                if with_ids:
                    columns.append(pa.array(map(bytes, bodies), pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    schema = "doc_id long, start_in_file long, n_tokens long, ids_crc32 long, file_no int" + (", ids binary" if with_ids else "")
    docs = blocks.drop("block_no", "n_tokens").mapInArrow(run, schema)
    # One row for each file; the running sum is over those rows.
    sums = blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("ids_in_file"))
    base = F.coalesce(F.sum("ids_in_file").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = sums.select("file_no", base.alias("before"))
    placed = docs.join(files, "file_no").withColumn("start", F.col("before") + F.col("start_in_file"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", "file_no", *(["ids"] if with_ids else []))
