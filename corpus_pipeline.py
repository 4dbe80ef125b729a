"""The corpus pipeline: language, lines, near duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on what the stage before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthtab.llm import decontamination, language, line_dedup, near_dup, packing
from synthtab.llm.common import fresh_path, ship
from synthtab.llm.queries import END_ID, vocabulary
from synthtab.session import drop_staged, staging

#: A document stays if one language holds at least this share of its words.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null and empty texts, texts without letters, and mixtures without a main language go.

    Of equal shares the first language by name counts; repeated rows share
    their fate; texts of any length are read whole; all columns stay.
    """
    ship(spark)
    model = language.train(docs.select("lang", "text"))
    if not model.languages:
        # Nothing is labelled, so no language can be told: only texts without letters go.
        return docs.where(F.col("text").rlike("\\p{L}"))
    return language.keep_documents(docs, model, LEAST_SHARE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; a document with no other line goes.

    Null and empty texts stay as they are.  The earliest of equal lines is that
    of the smallest doc_id (null first); repeated rows keep the same lines.
    """
    ship(spark)
    return line_dedup.without_repeated_lines(docs, exact_words=line_dedup.ANY_LINE)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays.  Rows with a null id or without words stay;
    repeated rows are one document and stay or go together.
    """
    ship(spark)
    return near_dup.without_near_duplicates(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text, null and empty texts hold none."""
    ship(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 4096 tokens; a null or empty text is its end token alone."""
    ship(spark)
    return packing.pack(docs, vocabulary(), END_ID, capacity=4096)


STAGES = [
    ("language", language_stage), ("lines", line_stage), ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage),
]

#: EM, signatures and tokenizers are no SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read by the next.

    What a stage stages for itself goes when it is written, and its input
    when the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_staged(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
