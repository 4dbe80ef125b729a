import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from synthtab.llm import sharding
from synthtab.llm.common import fresh_path
from synthtab.llm.queries import SHARDS
from synthtab.session import staging

TREE = sharding.even_tree(SHARDS)


def uniform(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute_shard(tree, doc_id):
    doc, left, path = "" if doc_id is None else str(doc_id), list(tree), []
    for level in range(3):
        names = {}
        for leaf in left:
            names.setdefault("/".join(map(str, leaf[: level + 1])), []).append(leaf)
        draws = {n: -math.log(uniform(f"{n}|{doc}")) / w for n, x in names.items() if (w := sum(leaf.weight for leaf in x)) > 0}
        path = min(draws, key=draws.get)
        left = names[path]
    return left[0].shard


def brute_report(rows, tree, larger):
    out, shards = [], {}
    for doc_id, text in rows:
        body = (text or "").encode()
        size, crc = len(body) + 16, zlib.crc32(body)
        turn = hashlib.md5(f"slot|{'' if doc_id is None else doc_id}|{size}|{crc}".encode()).hexdigest()[:13]
        shards.setdefault(brute_shard(tree, doc_id), []).append((turn, doc_id is not None, doc_id or 0, size, crc))
    for shard, members in shards.items():
        for slot, (_, known, doc_id, size, crc) in enumerate(sorted(members)):
            doc = doc_id if known else None
            out.append((doc, size, crc, "key", shard, slot, brute_shard(larger, doc)))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [sharding.COPIES, 7])
def test_report_equals_brute_force(spark, make, odd, monkeypatch, copies):
    monkeypatch.setattr(sharding, "COPIES", copies)
    rows = [*odd, *((i, f"text {i}") for i in range(100, 400)), *[(77, "the same row")] * 50, *[(None, "no id")] * 20]
    for some in (rows, []):
        with staging(spark):
            found = sharding.shard_report(make(some), TREE, sharding.grown(TREE)).collect()
        assert sorted(map(tuple, found), key=str) == brute_report(some, TREE, sharding.grown(TREE))


def test_weights_and_a_weight_of_zero(spark):
    tree = [sharding.Leaf("a", "k", 3, 1.0), sharding.Leaf("a", "m", 9, 4.0), sharding.Leaf("b", "k", 5, 0.0), sharding.Leaf("c", "k", 1, 5.0)]
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    counts = dict(sharding.with_shards(docs, tree, "s").groupBy("s").count().collect())
    assert set(counts) == {1, 3, 9} and all(abs(counts[s] / 20_000 - w) < 0.015 for s, w in ((1, 0.5), (9, 0.4), (3, 0.1)))
    for wrong in ([*tree, tree[0]], [tree[2]], [tree[0]._replace(weight=-1.0)]):
        with pytest.raises(ValueError):
            sharding.with_shards(docs, wrong)


def test_a_change_moves_rows_only_where_weights_change(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    taken = sharding.moves(docs, TREE, sharding.grown(TREE, 2)).collect()
    assert {r["to_shard"] for r in taken} == {40, 41} and sum(r["n_rows"] for r in taken) < 8000 * 2 / 42 * 1.2
    assert all(r["n_bytes"] == 2 * r["n_rows"] for r in taken)
    # A heavier shard takes rows into its rack and region; racks of the other region exchange none.
    heavier = [x._replace(weight=3.0) if x.shard == 7 else x for x in TREE]
    region, rack = {x.shard: x.region for x in TREE}, {x.shard: (x.region, x.rack) for x in TREE}
    for r in sharding.moves(docs, TREE, heavier).collect():
        a, b = r["from_shard"], r["to_shard"]
        assert region[b] == "r0" and (rack[b] == rack[7] or region[a] == "r1")
        assert b == 7 or rack[a] != rack[b]


def test_files_hold_whole_rows(spark, make, odd):
    docs = make(odd)
    with staging(spark):
        path = fresh_path(spark, "test-shards")
        sharding.write_shards(docs.withColumn("shard", F.lit("mine")).withColumn("part", F.lit(1)), TREE, path, parts=2)
        back = spark.read.parquet(path)
        assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
        assert all(r["shard_"] == brute_shard(TREE, r["doc_id"]) and r["shard"] == "mine" for r in back.collect())


def test_no_python_in_the_plan(spark, make, odd):
    with staging(spark):
        plan = sharding.shard_report(make(odd), TREE, sharding.grown(TREE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_keys_are_cut_into_runs(spark, make, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 1)
    monkeypatch.setattr(sharding, "LEAST_BITS", 0)
    rng = random.Random(1)
    rows = [(rng.choice([5, i]), f"text {i}") for i in range(600)]
    with staging(spark):
        found = sharding.shard_report(make(rows), TREE[:3], TREE).collect()
    assert sorted(map(tuple, found), key=str) == brute_report(rows, TREE[:3], TREE)
