"""Helpers shared by the text operators: folders, staged tables, Arrow batches and joins with hot keys."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthtab.session import drop_staged as drop_stage
from synthtab.session import staged_path as fresh_path

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were started elsewhere; Spark sends it to executors."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp(prefix='synthtab-code-')}/synthtab.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(name)
        _shipped.add(context.applicationId)


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder, which survives lost executors, and the path to drop later."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and the whole text as UTF-8 bytes (null: empty); other columns never travel along."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *extra,
    )


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in ``column`` (one row at least), to bound memory."""
    start, held = 0, 0
    for at, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_cells(rows: DataFrame, cells: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``cells``, which have one row for each key.

    Always a sort-merge join, at any size, so that adaptive execution (on by
    default) cuts every partition of ``rows`` beyond its limit of bytes into
    several tasks and gives each the cells: a key may hold any share of the
    rows, and any number of keys may be hot.  ``cells`` have to be a staged
    table for that (an aggregate right below the join would be bound to its
    partitions), and what follows must not ask for the same keys again.
    """
    return rows.join(cells.hint("merge"), keys, how)
