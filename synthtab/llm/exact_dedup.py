"""Exact duplicates by most-significant-digit radix partitioning of whole texts.

A round takes the next bytes of every text that is still in question (64, then
eight times more each round, 65,536 at most) and splits each group by them.  A
text alone in its cell is done, as are the texts that end in it together;
the rest goes to the next round with what is left of it.  Equality is that of
all bytes: no digest is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, fresh_path, join_cells, write_stage

FIRST_DIGIT = 64
GROWTH = 8
LONGEST_DIGIT = 1 << 16


def normalised(text: str = "text"):
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def split_groups(rows: DataFrame, width: int) -> tuple[str, int]:
    """One round: the folder of its rows (``open=false``: done), and the number of those still in question."""
    spark = rows.sparkSession
    digit = F.substring("body", 1, width)
    cells = rows.groupBy("label", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    cells, cells_path = write_stage(cells, "radix-cells")
    cells = cells.withColumn("next", F.monotonically_increasing_id()).withColumn("ended", F.length("digit") < width)
    open_rows = cells.where(~F.col("ended")).agg(F.sum("n")).first()[0] or 0
    met = join_cells(rows.withColumn("digit", digit), cells, ["label", "digit"], "left")
    goes_on = F.coalesce(~F.col("ended"), F.lit(False))
    met = met.select(
        "doc_id", "sha", goes_on.alias("open"), F.when(goes_on, F.col("next")).alias("label"),
        F.when(goes_on, F.substr("body", F.lit(width + 1))).alias("body"),
        F.coalesce("least", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
    )
    path = fresh_path(spark, "radix-round")
    met.write.partitionBy("open").option("compression", "zstd").parquet(path)
    drop_stage(spark, cells_path)
    return path, open_rows


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of equal normalised texts the smallest doc_id stays.  Null texts equal
    empty ones.  Rows that repeat a doc_id with the same text count in
    ``group_size`` and share their fate; a null doc_id never wins over another
    and stays only among null ids.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = normalised()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("label"), body.cast("binary").alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"),
    )
    done, width = [], FIRST_DIGIT
    old = None
    while True:
        path, left = split_groups(rows, width)
        if old:
            drop_stage(spark, f"{old}/open=true")
        done.append(spark.read.schema("doc_id long, sha binary, keep_id long, group_size long").parquet(f"{path}/open=false") if _has(spark, f"{path}/open=false") else None)
        if not left:
            break
        old = path
        rows = spark.read.schema("doc_id long, sha binary, label long, body binary").parquet(f"{path}/open=true")
        width = min(width * GROWTH, LONGEST_DIGIT)
    done = [d for d in done if d is not None]
    if not done:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _has(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
