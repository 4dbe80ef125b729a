"""Near duplicates by a multi-index Hamming join of b-bit min-hash signatures, confirmed on full shingle sets.

A signature has 32 positions of 16 bits and is cut into 8 chunks of 4.  Two
signatures that differ in at most 15 positions have a chunk with at most one
error (pigeonhole), so each chunk is a key four times, once without each
position: all pairs within the distance share a key.  At a similarity of 0.8
a position differs with probability 0.2, and more than 15 of 32 differ in
about one pair of 5,000; above 0.85 in one of a million.

Texts with equal shingle sets are one class.  Pairs of classes are found in
two steps, so that large groups are never written as all pairs: members of a
key against its first and last member; then, between members of different
components, all pairs within the distance that a sketch of 512 bins does not
rule out by five standard deviations.  In the second step a key's members lie
in blocks of bounded bytes; members that a sketch leaves a partner bring their
full sets into the block once, links are confirmed there, and a block passes
on a spanning forest of them, at most one link a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, free_name, join_cells, slices, texts, write_stage
from synthtab.llm.components import connected
from synthtab.llm.shingles import SLICE, constants, mix, shingle_sets, signatures

POSITIONS = 32
CHUNKS = 8
WIDTH = POSITIONS // CHUNKS
#: Errors that leave one chunk with at most one: 2 * CHUNKS - 1.
DISTANCE = 2 * CHUNKS - 1
#: Bytes of a key's members, with their full sets, compared at once, and those of a member besides its set.
BLOCK_BYTES = 4 << 20
MEMBER_BYTES = 700
BIN_BITS = 9
BINS = 1 << BIN_BITS


def features(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, row_no, n_shingles, set_a, set_b, sig`` of every document; ``row_no`` tells rows with one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                a, b = set_sums(sets)
                sig = [x.astype("<u2").tobytes() for x in signatures(sets, POSITIONS)]
                columns = [batch.column("doc_id"), batch.column("row_no"), pa.array(map(len, sets), pa.int64()), pa.array(a), pa.array(b), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_no", "n_shingles", "set_a", "set_b", "sig"])

    rows = texts(docs, F.xxhash64("text").alias("row_no"))
    return rows.mapInArrow(run, "doc_id long, row_no long, n_shingles long, set_a long, set_b long, sig binary")


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The 32 keys of each signature: chunk by chunk, without one position each."""
    out = np.empty((len(sig), POSITIONS), np.uint64)
    factor = constants(WIDTH, 401)
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            part = sig[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64) + np.uint64(1)
            for v in range(WIDTH):
                kept = [j for j in range(WIDTH) if j != v]
                value = sum(part[:, j] * factor[j] for j in kept)
                out[:, c * WIDTH + v] = mix(value + np.uint64((c * WIDTH + v) << 40))
    return out


def keyed(classes: DataFrame) -> DataFrame:
    """``id, size, key, slot``: one row for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = index_keys(as_signatures(batch.column("sig").to_pylist())).view(np.int64)
                ids, sizes = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), POSITIONS) for c in ("id", "size"))
                slot = np.tile(np.arange(POSITIONS, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, sizes, keys.reshape(-1), slot)], ["id", "size", "key", "slot"])

    return classes.select("id", "size", "sig").mapInArrow(run, "id long, size long, key long, slot int")


def as_signatures(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), POSITIONS)


def within_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes whose signatures differ in at most ``DISTANCE`` positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (as_signatures(batch.column("sig_a").to_pylist()) != as_signatures(batch.column("sig_b").to_pylist())).sum(axis=1) <= DISTANCE
                yield batch.select(["a", "b"]).filter(pa.array(near))

    one = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    two = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``100 * intersection >= percent * union``."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("set_a"), batch.column("set_b"))
            links = [similar(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), percent) for a, b in both]
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    one = sets.select(F.col("id").alias("b"), F.col("body").alias("set_b"))
    two = sets.select(F.col("id").alias("a"), F.col("body").alias("set_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def likely(one: np.ndarray, many: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which of ``many`` sketches may belong to a set that is similar to ``one``'s: five standard deviations are allowed."""
    seen = (many != 0) | (one != 0)
    m = np.maximum(seen.sum(axis=1), 1)
    share = ((many == one) & seen).sum(axis=1) / m
    least = percent / 100
    union = (sizes + size) / (1 + least)
    # Bins are drawn without replacement from the union, so small sets are seen nearly whole.
    spread = np.sqrt(least * (1 - least) / m * np.clip(1 - (m - 1) / np.maximum(union, 1), 0, 1))
    fits = 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
    return fits & (share >= least - 5 * spread - 0.02)


def pairs_of_block(block: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(visitor, residents) as row numbers: pairs of one block that may be similar, of different components."""
    guests, here = np.flatnonzero(block["visitor"]), np.flatnonzero(~block["visitor"])
    if not len(guests) or not len(here):
        return
    sig, sketch, ids, parts = (block[c][here] for c in ("sig", "sketch", "id", "component"))
    moves, sizes, slot = block["moves"][here], block["size"][here], int(block["slot"][0])
    for g in guests.tolist():
        one = block["id"][g]
        keep = (parts != block["component"][g]) & (~moves | (ids > one))
        at = np.flatnonzero(keep)
        wrong = sig[at] != block["sig"][g]
        near = wrong.sum(axis=1) <= DISTANCE
        at, wrong = at[near], wrong[near]
        if len(at):
            # Only in the first slot that both share: the first chunk with an error at most, without the wrong position
            # (without position 0 if nothing is wrong, as then every variant is shared).
            chunk = wrong.reshape(len(at), CHUNKS, WIDTH)
            first = (chunk.sum(axis=2) <= 1).argmax(axis=1)
            inside = chunk[np.arange(len(at)), first]
            at = at[first * WIDTH + inside.argmax(axis=1) == slot]
            at = at[likely(block["sketch"][g], sketch[at], sizes[at], int(block["size"][g]), percent)]
            if len(at):
                yield g, here[at]


def members_with_partners(block: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Row numbers of the members that the sketches leave a partner in this block."""
    found = [np.append(at, g) for g, at in pairs_of_block(block, percent)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def forest_of_block(block: dict[str, np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Confirmed links of one block that join components not yet joined by others."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for g, others in pairs_of_block(block, percent):
        mine = np.frombuffer(block["body"][g], "<u8")
        for r in others.tolist():
            one, two = find(int(block["component"][g])), find(int(block["component"][r]))
            if one != two and similar(mine, np.frombuffer(block["body"][r], "<u8"), percent):
                root[max(one, two)] = min(one, two)
                a.append(int(block["id"][g]))
                b.append(int(block["id"][r]))
    return a, b


PLACE = {"key": "long", "home": "int", "guest": "int"}
MEMBER = {"visitor": "boolean", "moves": "boolean", "slot": "int", "id": "long", "component": "long", "size": "long"}
SETS = {"sig": "binary", "sketch": "binary", "body": "binary"}


def by_block(rows: DataFrame, work, names: list[str], out: str) -> DataFrame:
    """``work`` on each block of ``rows``: all rows with one ``key, home, guest`` as a table of numpy columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done(table: dict[str, np.ndarray], edges: list[int]) -> Iterator[pa.RecordBatch]:
            for start, stop in zip(edges[:-1], edges[1:]):
                block = {c: v[start:stop] for c, v in table.items()}
                if block["visitor"].any() and not block["visitor"].all():
                    yield from work(block)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*PLACE, *MEMBER)}
            new["sig"] = as_signatures(batch.column("sig").to_pylist())
            new["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            if "body" in names:
                new["body"] = np.array([*batch.column("body").to_pylist(), None], object)[:-1]
            table = {c: np.concatenate([held[c], v]) for c, v in new.items()} if held else new
            change = np.zeros(len(table["key"]) - 1, bool)
            for c in PLACE:
                change |= table[c][1:] != table[c][:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            yield from done(table, edges)
            held = {c: v[edges[-1] :] for c, v in table.items()}  # the last block may go on
        if held:
            yield from done(held, [0, len(held["key"])])

    return rows.select(*PLACE, *MEMBER, *names).repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, out)


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: confirmed links between the components of each key that join them all that can be joined.

    ``members``: ``key, slot, id, size, component, main`` (the key's most
    frequent component) and ``bytes`` (of the key's members with their sets).
    A key's rows live in blocks; those outside the main component visit all
    its blocks.  ``sets`` has the full set of each member.
    """
    spark = members.sparkSession
    blocks = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")
    rows = members.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int"), "moves": F.col("component") != F.col("main")})
    anywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A resident meets the visitors of each block in a task of its own.
    stay = rows.withColumns({"visitor": F.lit(False), "home": F.col("own"), "guest": F.explode(anywhere)})
    visit = rows.where("moves").withColumns({"visitor": F.lit(True), "guest": F.col("own"), "home": F.explode(anywhere)})
    both = stay.select(*PLACE, *MEMBER).unionByName(visit.select(*PLACE, *MEMBER))

    def ask(block: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = members_with_partners(block, percent)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(block[c][at]) for c in (*PLACE, *MEMBER)], [*PLACE, *MEMBER])

    def confirm(block: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = forest_of_block(block, percent)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    slim = ["sig", "sketch"]
    asked = by_block(both.join(sets.select("id", *slim), "id"), ask, slim, ", ".join(f"{c} {k}" for c, k in (PLACE | MEMBER).items()))
    asked, path = write_stage(asked, "near-partners")
    links, _ = write_stage(by_block(asked.join(sets.select("id", *SETS), "id"), confirm, list(SETS), "a long, b long"), "near-links")
    drop_stage(spark, path)
    return links


def sketch_of(values: np.ndarray) -> bytes:
    """The smallest hash in each of ``BINS`` bins as one byte, 0 for an empty bin."""
    out = np.zeros(BINS, np.uint8)
    if len(values):
        turned = np.sort(mix(values ^ constants(1, 907)[0]))
        bins = (turned >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        first = np.append(True, bins[1:] != bins[:-1])
        out[bins[first]] = 1 + (turned[first] >> np.uint64(20)) % np.uint64(255)
    return out.tobytes()


def set_sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that stand for a set."""
    one, two = constants(2, 307)
    sums = [[mix(s ^ x).sum() for s in sets] for x in (one, two)]
    return tuple(np.array(x, np.uint64).view(np.int64) for x in sums)


def shingle_table(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``id, sig, body, sketch``: the full sets of the classes that may have a partner, with a finer sketch of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                a, b = set_sums(sets)
                # A doc_id may stand on several rows: only rows with the class's own set count.
                own = (a == batch.column("set_a").to_numpy()) & (b == batch.column("set_b").to_numpy())
                body = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                sketch = pa.array([sketch_of(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sig"), body, sketch], ["id", "sig", "body", "sketch"]).filter(pa.array(own))

    # Always a shuffle: few ids here are many where texts are many.
    asked = classes.select("doc_id", "id", "sig", "set_a", "set_b").hint("merge")
    return texts(docs).join(asked, "doc_id").mapInArrow(run, "id long, sig binary, body binary, sketch binary")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the first document of each near-duplicate group; null ids and empty texts stay.

    Only what goes is joined, by id and text: a row that repeats an id with
    another text goes or stays by its own component.
    """
    gone, gone_row = free_name(docs, "gone"), free_name(docs, "gone_row")
    rows = near_rows(docs, words, percent).where("not kept").select(F.col("doc_id").alias(gone), F.col("row_no").alias(gone_row)).distinct()
    return docs.join(rows, (F.col("doc_id").cast("long") == F.col(gone)) & (F.xxhash64("text") == F.col(gone_row)), "left_anti")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Links are pairs with a shingle similarity of ``percent`` or more; a
    component is named by its smallest doc_id, and that document is kept.
    Null, empty and white texts have no shingles and stand alone.  Rows that
    repeat a doc_id are documents of their own with that id; null ids stand
    alone and are kept.  An empty table gives no rows.
    """
    return near_rows(docs, words, percent).drop("row_no")


def near_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_groups`` with the ``row_no`` of each row."""
    spark = docs.sparkSession
    rows, rows_path = write_stage(features(docs, words), "near-features")
    known = rows.where("doc_id is not null and n_shingles > 0")
    sets = known.groupBy("set_a", "set_b").agg(F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("first"), F.first("n_shingles").alias("size"))
    sets = sets.select("set_a", "set_b", F.col("first.doc_id").alias("doc_id"), F.col("first.sig").alias("sig"), "size")
    classes, classes_path = write_stage(sets.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    keys = keyed(classes)
    cells = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    cells, cells_path = write_stage(cells, "near-cells")
    members, members_path = write_stage(join_cells(keys, cells, ["key"]), "near-members")
    some = members.select("id").distinct()
    asked, asked_path = write_stage(classes.join(some, "id", "left_semi"), "near-asked")
    bodies, bodies_path = write_stage(shingle_table(docs, asked, words), "near-sets")
    # Members of a key against its first and its last.
    ends = [members.select(F.least("id", end).alias("a"), F.greatest("id", end).alias("b")).where("a <> b") for end in ("least", "most")]
    links, links_path = write_stage(verified(within_distance(ends[0].unionByName(ends[1]).distinct(), asked), bodies, percent), "near-links")
    parts, parts_path = connected(links)
    placed = members.join(parts.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # A key whose members are in one component has no more to give.
    mixed = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8 + MEMBER_BYTES).alias("bytes")).groupBy("key").agg(
        F.max_by("component", "n").alias("main"), F.count(F.lit(1)).alias("components"), F.sum("bytes").alias("bytes")
    )
    mixed, mixed_path = write_stage(mixed.where("components > 1").select("key", "main", "bytes"), "near-mixed")
    placed = join_cells(placed.select("key", "slot", "id", "size", "component"), mixed, ["key"])
    more = across(placed, bodies, percent)
    drop_stage(spark, parts_path, mixed_path)
    parts, _ = connected(links.unionByName(more))
    placed = classes.select("id", "doc_id", "set_a", "set_b").join(parts.withColumnRenamed("v", "id"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    names, _ = write_stage(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-names")
    named = join_cells(placed, names, ["component"]).select("set_a", "set_b", "component_id")
    grouped = join_cells(known.select("doc_id", "row_no", "n_shingles", "set_a", "set_b"), named, ["set_a", "set_b"])
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "row_no", "n_shingles", F.col("doc_id").alias("component_id"))
    out = grouped.select("doc_id", "row_no", "n_shingles", "component_id").unionByName(alone)
    drop_stage(spark, cells_path, members_path, asked_path, bodies_path, links_path)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
