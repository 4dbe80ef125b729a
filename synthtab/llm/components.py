"""Connected components of links, with hot vertices: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, join_cells, write_stage


def star(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """Join the neighbours of each vertex to the smallest of them; staged, with the paths to drop later.

    Large: neighbours greater than the vertex.  Small: the vertex itself and
    neighbours smaller than it.
    """
    if large:
        near = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    else:
        near = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    least = near.groupBy("v").agg(F.min("w").alias("least"))
    least, path = write_stage(least, "links-least")
    met = join_cells(near, least, ["v"]).withColumn("m", F.least("v", "least"))
    if large:
        out = met.where("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("w > m").select(F.col("w").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("v").alias("a"), F.col("least").alias("b")))
    out, links = write_stage(out.where("a <> b").distinct(), "links")
    return out, [path, links]


def connected(links: DataFrame) -> tuple[DataFrame, str]:
    """``v, component`` (its smallest member) of every vertex of ``links(a, b)``; staged, with its path.

    Null ends are ignored, as are links of a vertex with itself.
    """
    spark = links.sparkSession
    edges, path = write_stage(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == seen or not seen["n"]:
            break
        before = seen
        grown, first = star(edges, True)
        edges, second = star(grown, False)
        drop_stage(spark, path, *first, *second[:-1])
        path = second[-1]
    out = edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    out, done = write_stage(out.unionByName(roots), "components")
    drop_stage(spark, path)
    return out, done
