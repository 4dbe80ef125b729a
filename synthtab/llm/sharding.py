"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

The leaves of the tree are shards, held by racks, held by regions; a node
weighs as much as its leaves.  A document descends from the root: every child
draws ``-ln(u) / weight`` from a hash of its own path and the doc_id, and the
smallest draw wins, so a child gets documents in proportion to its weight.  A
draw depends on nothing but that child, so a changed weight moves documents
into or out of the subtrees where weights change, and nowhere else.  Shards
that are added open a region of their own: they take documents, and no other
two shards exchange any.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthtab.llm.common import free_name, write_stage

#: Distinct rows of a shard numbered in one task, about; a shard has ``2 ** LEAST_BITS`` such runs at least.
RUN_ROWS = 4096
LEAST_BITS = 4
#: Copies of one row that a task writes out.
COPIES = 1 << 16
#: Added to the UTF-8 bytes of a text: what a document takes besides.
OVERHEAD = 16


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 4) -> list[Leaf]:
    """``shards`` leaves of equal weight, in ``racks`` racks in each of ``regions`` regions."""
    groups = regions * racks
    place = [i * groups // shards for i in range(shards)]
    return [Leaf(f"r{g // racks}", f"k{g % racks}", i) for i, g in enumerate(place)]


def grown(tree: Sequence[Leaf], shards: int = 1, weight: float = 1.0) -> list[Leaf]:
    """``tree`` with new shards, each in a new region: documents move into them only."""
    first = max(leaf.shard for leaf in tree) + 1
    return [*tree, *(Leaf(f"added{i}", "k0", i, weight) for i in range(first, first + shards))]


def _options(names: dict[str, float]) -> Column:
    """Children that can win, as an array of ``name, weight, at`` (their place among all children)."""
    some = [(n, w, i) for i, (n, w) in enumerate(names.items()) if w > 0]
    made = [F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at")) for n, w, i in some]
    return F.array(*made) if made else F.array().cast("array<struct<name:string,weight:double,at:int>>")


def _winner(options: Column, doc: Column) -> Column:
    """``at`` of the child with the smallest weighted draw; the first of equal ones."""

    def draw(child: Column) -> Column:
        digest = F.md5(F.concat(child["name"], F.lit("|"), doc))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["at"].alias("at"))

    return F.array_min(F.transform(options, draw))["at"]


def shard_of(tree: Sequence[Leaf], doc_id: Column) -> Column:
    """The shard of a doc_id (null: a key of its own, the empty text)."""
    if len({leaf.shard for leaf in tree}) < len(tree) or any(leaf.weight < 0 for leaf in tree) or not any(leaf.weight for leaf in tree):
        raise ValueError("a tree needs different shards, and weights of 0 or more, not all 0")
    nested: dict[str, dict[str, dict[int, float]]] = {}
    for leaf in tree:
        nested.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    doc = F.coalesce(doc_id.cast("string"), F.lit(""))
    top = {r: sum(sum(s.values()) for s in racks.values()) for r, racks in nested.items()}
    rack_options = [_options({f"{r}/{k}": sum(s.values()) for k, s in racks.items()}) for r, racks in nested.items()]
    shard_options = [F.array(*(_options({f"{r}/{k}/{s}": w for s, w in shards.items()}) for k, shards in racks.items())) for r, racks in nested.items()]
    numbers = [F.array(*(F.array(*map(F.lit, shards)) for shards in racks.values())) for racks in nested.values()]
    # Every level is computed once, and handed down in a struct.
    region = F.transform(F.array(_winner(_options(top), doc)), lambda r: F.struct(r.alias("r"), _winner(F.get(F.array(*rack_options), r), doc).alias("k")))
    shard = F.transform(region, lambda p: F.get(F.get(F.get(F.array(*numbers), p["r"]), p["k"]), _winner(F.get(F.get(F.array(*shard_options), p["r"]), p["k"]), doc)))
    return F.get(shard, F.lit(0))


def with_shards(docs: DataFrame, tree: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row in column ``name``: a projection, nothing moves."""
    return docs.withColumn(name, shard_of(tree, F.col("doc_id")))


def write_shards(docs: DataFrame, tree: Sequence[Leaf], path: str, parts: int = 8) -> None:
    """Whole rows as Parquet, one folder ``shard=N`` a shard, each written by up to ``parts`` tasks.

    The part of a row follows from its doc_id and text, so a shard or a
    doc_id with very many rows is no single task's work.
    """
    shard, part = free_name(docs, "shard"), free_name(docs, "part")
    rows = with_shards(docs, tree, shard).withColumn(part, F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    rows.repartition(shard, part).drop(part).write.partitionBy(shard).parquet(path)


def moves(docs: DataFrame, old: Sequence[Leaf], new: Sequence[Leaf]) -> DataFrame:
    """``from_shard, to_shard, n_rows, n_bytes``: what a change of the tree moves, counted before any shuffle."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    both = docs.select(shard_of(old, F.col("doc_id")).alias("from_shard"), shard_of(new, F.col("doc_id")).alias("to_shard"), size.cast("long").alias("size"))
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def shard_report(docs: DataFrame, tree: Sequence[Leaf], larger: Sequence[Leaf]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of a
    hash of doc_id, size and checksum, then of these themselves (null ids
    first); rows alike in all three take slots that follow one another.  Rows
    with one doc_id, null too, share a shard.  A null text counts as empty.  An
    empty table gives no rows.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # Equal rows are counted before anything is shuffled, and written out again at the end.
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("|", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    turn = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    rows, _ = write_stage(rows.withColumns({"shard": shard_of(tree, F.col("doc_id")), "grown_shard": shard_of(larger, F.col("doc_id")), "turn": turn}), "shard-rows")
    bits = max(LEAST_BITS, ceil(log2(max(1.0, rows.count() / (len(tree) * RUN_ROWS)))))
    rows = rows.withColumn("run", F.shiftright("turn", 52 - bits))
    # A shard is numbered run by run; where a run begins is summed up from the runs' counts.
    inside = W.partitionBy("shard", "run").orderBy("turn", F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    runs = rows.groupBy("shard", "run").agg(F.sum("n").alias("rows"))
    earlier = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("shard", "run", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    rows = rows.join(runs, ["shard", "run"]).withColumn("first", F.col("start") + F.col("before"))
    # A row with very many copies is written out piece by piece, in different tasks.
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("turn", "piece")
    low = F.col("piece") * COPIES
    out = pieces.withColumn("slot", F.explode(F.sequence(F.col("first") + low, F.col("first") + F.least(low + COPIES, F.col("n")) - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
