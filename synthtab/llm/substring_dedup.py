"""Repeated passages by content-defined chunks: a gear rolling hash cuts, equal digests are duplicates.

The gear hash of a byte depends on the 16 bytes up to it, and a chunk ends
where it is small enough, so cuts move with the text: an insertion changes the
chunks around it and no others.  The first place of a digest (lowest doc_id,
then place) stays; chunks that repeat it are seeds, which are extended byte by
byte against the text at that place, and spans of at least ``min_bytes`` are
reported, so a lone short chunk is never a passage.

A chunk carries checksums of as many bytes before and behind it as it needs
on one side at least to become a passage, so a lone seed that cannot is left
out before any text is opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, free_name, join_cells, slices, texts, write_stage
from synthtab.llm.shingles import constants

SLICE = 4 << 20
#: One byte in so many ends a chunk.
AVERAGE = 40
#: A chunk ends here at the latest.
LONGEST = 4096
MIN_BYTES = 80
#: Bytes compared on each side of a seed at first; later windows are 16 times as long.
WINDOW = 64
#: Bytes in which a span's end looks for the end of a word.
BACK = 32
THREAD = ["doc_id", "row_no", "start", "stop", "of_doc", "of_row", "of_start", "of_stop", "size", "seed", "strong", "left_open", "right_open"]
GEAR = (constants(256, 503) >> np.uint64(40)).astype(np.uint16)
DIGEST = ["digest_a", "digest_b"]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte the sum of its own gear value and those of the 15 before it, shifted by their distance."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    return h


def cuts(data: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Ends of the chunks of one text, never inside a character (but for chunks of ``LONGEST`` bytes)."""
    whole = np.append((data[1:] & 0xC0) != 0x80, True)
    ends = np.flatnonzero((gear_hashes(data) < 65536 // average) & whole) + 1
    ends = np.unique(np.append(ends, len(data)))
    gaps = np.diff(np.append(0, ends))
    if (gaps > LONGEST).any():
        more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST])]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends[ends > 0]


def repeated_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``several``: the doc_ids of more than one row, and null; staged."""
    ids = docs.select(F.col("doc_id").cast("long").alias("several")).groupBy("several").agg(F.count(F.lit(1)).alias("n"))
    return write_stage(ids.where("n > 1 or several is null").select("several"), "chunk-ids")


def with_row_no(docs: DataFrame, ids: DataFrame, name: str, id_name: str = "several") -> DataFrame:
    """``docs`` with a column that tells rows of one doc_id apart: a hash of the text, 0 where the id stands once."""
    met = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)), "left_outer")
    several = F.col(id_name).isNotNull() | F.col("doc_id").isNull()
    return met.withColumn(name, F.when(several, F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(F.lit(0).cast("long"))).drop(id_name)


def bodies_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, row_no, text`` (bytes): every document once; rows alike in id and text are one."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ids.isEmpty():
        return texts(plain, F.lit(0).cast("long").alias("row_no"))
    rows = texts(with_row_no(plain, ids, "row_no"), "row_no")
    again = (F.col("row_no") != 0) | F.col("doc_id").isNull()
    once = rows.where(again).groupBy("doc_id", "row_no").agg(F.first("text").alias("text"))
    return rows.where(~again).unionByName(once)


#: What ``info`` of a chunk holds, by its lowest bit: bytes, whether it ends its text, and checksums of its surroundings.
ENDS_AT, LEFT_AT, RIGHT_AT = 13, 16, 32


def surroundings(text: bytes, begin: int, end: int, min_bytes: int) -> int:
    """Checksums (1 to 65,535; 0: too few bytes) of the bytes that a chunk needs on one side to grow to ``min_bytes``."""
    need = max(1, (min_bytes - (end - begin) + 1) // 2)
    left = 1 + crc32(text[begin - need : begin]) % 65535 if begin >= need else 0
    right = 1 + crc32(text[end : end + need]) % 65535 if end + need <= len(text) else 0
    return left << LEFT_AT | right << RIGHT_AT


def chunks(bodies: DataFrame, average: int, min_bytes: int) -> DataFrame:
    """``doc_id, row_no, start, info`` and the 128-bit digest of every chunk of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                counts, starts, infos, digests = [], [], [], []
                for text in batch.column("text").to_pylist():
                    ends = cuts(np.frombuffer(text, np.uint8), average) if text else np.zeros(0, np.int64)
                    begins = np.append(0, ends[:-1])[: len(ends)]
                    places = list(zip(begins.tolist(), ends.tolist()))
                    digests.extend([blake2b(text[a:b], digest_size=16).digest() for a, b in places])
                    infos.extend([b - a | surroundings(text, a, b, min_bytes) for a, b in places])
                    if places:
                        infos[-1] |= 1 << ENDS_AT
                    counts.append(len(ends))
                    starts.append(begins)
                if digests:
                    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    of = pa.array(np.repeat(np.arange(len(counts)), counts))
                    columns = [
                        batch.column("doc_id").take(of), batch.column("row_no").take(of), pa.array(np.concatenate(starts)),
                        pa.array(infos, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_no", "start", "info", *DIGEST])

    return bodies.select("doc_id", "row_no", "text").mapInArrow(run, "doc_id long, row_no long, start long, info long, digest_a long, digest_b long")


def with_windows(threads: DataFrame, bodies: DataFrame, width: int, back: int) -> DataFrame:
    """``threads`` with the bytes before and behind them (``own_``) and their first place (``of_``), on open sides.

    A request is a place with its open sides, made once however many threads
    ask for it.  Every text that is asked for is opened once, and what is cut
    from it travels, not the text.
    """
    own = ["doc_id", "row_no", "start", "stop", "left_open", "right_open"]
    of = ["of_doc", "of_row", "of_start", "of_stop", "left_open", "right_open"]
    names = ["doc", "row", "begin", "end", "left_open", "right_open"]
    asked = threads.select(*(F.col(c).alias(n) for c, n in zip(own, names))).unionByName(threads.select(*(F.col(c).alias(n) for c, n in zip(of, names))))
    # The places of one text that are asked for are no more than it has bytes, as they are distinct.
    places = asked.groupBy("doc", "row").agg(F.collect_set(F.struct(*names[2:])).alias("places"))
    met = places.hint("merge").join(bodies, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("row") == F.col("row_no")))
    empty = F.lit(b"")

    def cut(p):
        low = F.greatest(p["begin"] - width, F.lit(0))
        before = F.substr("text", (low + 1).cast("int"), (p["begin"] + back - low).cast("int"))
        behind = F.substr("text", (p["end"] - back + 1).cast("int"), F.lit(width + back))
        return F.struct(p.alias("p"), F.when(p["left_open"], before).otherwise(empty).alias("left"), F.when(p["right_open"], behind).otherwise(empty).alias("right"))

    windows = met.select("doc", "row", F.explode(F.transform("places", cut)).alias("w")).select("doc", "row", "w.p.*", "w.left", "w.right")
    for columns, kind in ((own, "own"), (of, "of")):
        there = windows.select(*(F.col(n).alias(f"at_{n}") for n in names), F.col("left").alias(f"{kind}_left"), F.col("right").alias(f"{kind}_right"))
        same = F.col(columns[0]).eqNullSafe(F.col("at_doc"))
        for c, n in zip(columns[1:], names[1:]):
            same = same & (F.col(c) == F.col(f"at_{n}"))
        threads = threads.join(there.hint("merge"), same).drop(*(f"at_{n}" for n in names))
    return threads


CHAR = rb"(?:[0-9A-Za-z]|[\xc3-\xdf][\x80-\xbf])"
FIRST, LAST = re.compile(rb"\A" + CHAR), re.compile(CHAR + rb"\Z")
FIRST_WORD, LAST_WORD = re.compile(rb"\A" + CHAR + rb"+"), re.compile(CHAR + rb"+\Z")


def equal_start(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    other = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (other.bit_length() + 7) // 8


def equal_end(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    other = int.from_bytes(a[len(a) - n :], "little") ^ int.from_bytes(b[len(b) - n :], "little")
    return n - (other.bit_length() + 7) // 8


def behind(own: bytes, of: bytes, whole: int) -> tuple[int, int, bool]:
    """Bytes that are equal from the start, those up to a whole word's end, and whether more may be equal behind ``whole`` bytes."""
    n = equal_start(own, of)
    if n == whole:
        return n, n, True
    end = n
    while end and own[end : end + 1] and own[end] & 0xC0 == 0x80:
        end -= 1
    if FIRST.match(own[end:]) or FIRST.match(of[end:]):
        word = LAST_WORD.search(own[max(0, end - BACK) : end])
        end -= len(word.group()) if word else 0
    return n, end, False


def before(own: bytes, of: bytes, whole: int) -> tuple[int, int, bool]:
    """The same from the end backwards."""
    n = equal_end(own, of)
    if n == whole:
        return n, n, True
    start = n
    while start and own[len(own) - start] & 0xC0 == 0x80:
        start -= 1
    at, of_at = len(own) - start, len(of) - start
    if LAST.search(own[max(0, at - 2) : at]) or LAST.search(of[max(0, of_at - 2) : of_at]):
        word = FIRST_WORD.match(own[at : at + min(start, BACK)])
        start -= len(word.group()) if word else 0
    return n, start, False


def extended(threads: DataFrame, width: int, back: int) -> DataFrame:
    """Threads made longer by the equal bytes of their windows; ``size`` counts these all, ``start`` and ``stop`` keep to whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["left_open"]:
                    n, kept, r["left_open"] = before(r["own_left"], r["of_left"], width + back)
                    r["start"], r["of_start"], r["size"] = r["start"] + back - kept, r["of_start"] + back - kept, r["size"] + n - back
                if r["right_open"]:
                    n, kept, r["right_open"] = behind(r["own_right"], r["of_right"], width + back)
                    r["stop"], r["of_stop"], r["size"] = r["stop"] - back + kept, r["of_stop"] - back + kept, r["size"] + n - back
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], batch.schema.field(c).type) for c in THREAD})

    return threads.mapInArrow(run, ", ".join(f"{c} {threads.schema[c].dataType.simpleString()}" for c in THREAD))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, average: int = AVERAGE, extend: bool = False) -> DataFrame:
    """``doc_id, row_no, start, stop, of_docs``: byte spans (UTF-8) that repeat earlier text, and where that stands.

    Order is doc_id (null first), a hash of the text, and place, so a passage
    repeated within a document counts too.  Null and empty texts have no
    spans; rows alike in doc_id and text are one document.

    A thread is a run of chunks whose first places follow one another as well.
    With ``extend`` it is compared byte by byte with the text around its first place, in
    windows that grow; beyond the first window only where nothing that is
    already found goes on.  A thread is reported if it has ``min_bytes`` equal
    bytes, or if it is one of adjoining chunks of as many.
    """
    spark = docs.sparkSession
    ids, ids_path = repeated_ids(docs)
    bodies = bodies_of(docs, ids)
    pieces = chunks(bodies, average, min_bytes)
    place = F.struct("doc_id", "row_no", "start", "info")
    cells = pieces.groupBy(*DIGEST).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    cells, cells_path = write_stage(cells, "chunk-cells")
    again = join_cells(pieces, cells, DIGEST).where(F.col("first") < place)

    def same(low: int):
        """Whether the checksums on one side are there and equal."""
        own, of = (F.shiftright(c, low).bitwiseAND(F.lit(65535)) for c in (F.col("info"), F.col("first.info")))
        return (own != 0) & (own == of)

    ends = F.col("info").bitwiseOR(F.col("first.info")).bitwiseAND(F.lit(1 << ENDS_AT)) != 0
    again = again.select(
        "doc_id", "row_no", "start", (F.col("start") + F.col("info").bitwiseAND(F.lit((1 << ENDS_AT) - 1))).alias("stop"),
        F.col("first.doc_id").alias("of_doc"), F.col("first.row_no").alias("of_row"), F.col("first.start").alias("of_start"),
        (same(LEFT_AT) | same(RIGHT_AT)).alias("grows"), ends.alias("ends"),
    )
    in_doc = W.partitionBy("doc_id", "row_no").orderBy("start")
    so_far = in_doc.rowsBetween(W.unboundedPreceding, 0)
    opens = F.coalesce(F.lag("stop").over(in_doc) < F.col("start"), F.lit(True))
    follows = F.lag("of_doc").over(in_doc).eqNullSafe(F.col("of_doc")) & (F.lag("of_row").over(in_doc) == F.col("of_row"))
    follows = follows & (F.lag(F.col("start") - F.col("of_start")).over(in_doc) == F.col("start") - F.col("of_start"))
    runs = again.withColumns({"opens": opens.cast("long"), "parts": (opens | ~F.coalesce(follows, F.lit(False))).cast("long")})
    runs = runs.withColumns({"run": F.sum("opens").over(so_far), "thread": F.sum("parts").over(so_far)})
    runs = runs.withColumn("whole", F.sum(F.col("stop") - F.col("start")).over(W.partitionBy("doc_id", "row_no", "run")))
    threads = runs.groupBy("doc_id", "row_no", "run", "thread").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("of_doc").alias("of_doc"), F.first("of_row").alias("of_row"),
        F.min("of_start").alias("of_start"), F.max("whole").alias("whole"), F.count(F.lit(1)).alias("chunks"), F.bool_or("grows").alias("grows"), F.bool_or("ends").alias("ends"),
    )
    # A lone chunk that is too short, with other bytes on both sides, is no passage.
    strong = F.col("whole") >= min_bytes
    threads = threads.where(strong | (F.col("chunks") > 1) | F.col("grows"))
    size = F.col("stop") - F.col("start")
    # A side is open where both places have bytes beyond it.
    new = {
        "of_stop": F.col("of_start") + size, "size": size, "seed": F.col("start"), "strong": strong,
        "left_open": F.lit(extend) & (F.col("start") > 0) & (F.col("of_start") > 0), "right_open": F.lit(extend) & ~F.col("ends"),
    }
    state, state_path = write_stage(threads.withColumns(new).select(*THREAD), "threads")
    drop_stage(spark, cells_path)
    is_open = F.col("left_open") | F.col("right_open")
    width, back = WINDOW, 0
    while extend and not state.where(is_open).isEmpty():
        found = extended(with_windows(state.where(is_open), bodies, width, back), width, back)
        both = found.unionByName(state.where(~is_open))
        # A side goes on where no other thread covers what lies beyond it.
        low = W.partitionBy("doc_id", "row_no").orderBy("start", "seed").rowsBetween(W.unboundedPreceding, -1)
        high = W.partitionBy("doc_id", "row_no").orderBy(F.desc("stop"), "seed").rowsBetween(W.unboundedPreceding, -1)
        covered = F.coalesce(F.max("stop").over(low) >= F.col("start"), F.lit(False)), F.coalesce(F.min("start").over(high) <= F.col("stop"), F.lit(False))
        both = both.withColumns({"left_open": F.col("left_open") & ~covered[0], "right_open": F.col("right_open") & ~covered[1]})
        new_state, new_path = write_stage(both, "threads")
        drop_stage(spark, state_path)
        state, state_path = new_state, new_path
        width, back = width * 16, BACK
    drop_stage(spark, ids_path)
    kept = state.where(F.col("strong") | (F.col("size") >= min_bytes))
    reach = F.max("stop").over(in_doc.rowsBetween(W.unboundedPreceding, -1))
    merged = kept.withColumn("opens", F.coalesce(reach < F.col("start"), F.lit(True)).cast("long")).withColumn("run", F.sum("opens").over(so_far))
    return merged.groupBy("doc_id", "row_no", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set("of_doc")).alias("of_docs")).drop("run")


def span_report(docs: DataFrame, min_bytes: int = MIN_BYTES, extend: bool = False) -> DataFrame:
    """``doc_id, dup_bytes, spans, of_docs`` of every document with repeated passages.

    Documents without any (null and empty texts too) have no row; a null id is
    an id; rows alike in id and text are one document with one row, other rows
    with its id have their own; of equal passages the first place stays.
    """
    spans = repeated_spans(docs, min_bytes, extend=extend)
    grouped = spans.groupBy("doc_id", "row_no").agg(
        F.sum(F.col("stop") - F.col("start")).alias("dup_bytes"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.flatten(F.collect_list("of_docs")).alias("of_docs")
    )
    return grouped.select("doc_id", "dup_bytes", "spans", F.array_sort(F.array_distinct("of_docs")).alias("of_docs"))


def without_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, extend: bool = False) -> DataFrame:
    """``docs`` with the repeated spans cut from ``text``; all rows and columns stay."""
    of_doc, of_row, gone, own = (free_name(docs, x) for x in ("gone_doc", "gone_row", "gone", "gone_text"))
    spans = repeated_spans(docs, min_bytes, extend=extend).groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(gone))
    spans = spans.select(F.col("doc_id").alias(of_doc), F.col("row_no").alias(of_row), gone)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids, _ = repeated_ids(docs)
    several = free_name(docs, "several")
    rows = with_row_no(docs, ids.withColumnRenamed("several", several), own, several)
    met = rows.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(of_doc)) & (F.col(own) == F.col(of_row)), "left")
    # What lies between the spans; a cut inside a character is mended by the decoder.
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda s: s["stop"]))
    stops = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.length(body).cast("long")))
    parts = F.zip_with(begins, stops, lambda a, b: F.substr(body, (a + 1).cast("int"), (b - a).cast("int")))
    left = F.make_valid_utf8(F.aggregate(parts, F.lit("").cast("binary"), lambda x, y: F.concat(x, y)).cast("string"))
    return met.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
