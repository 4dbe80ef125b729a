"""Repeated lines by a deletion-neighbourhood join, in DataFrame operations only.

Two lines match when their words (lower case, white space aside) are equal or
differ by one word put in, left out or replaced.  A line and the line with one
word left out are its variants; equal variants join:

* the same variant with the same place left out: one word replaced;
* a variant that equals a whole line: one word put in.

Variants are joined as groups with their earliest member, never as pairs.  A
line whose earliest neighbour comes before it is dropped, as is every repeated
line but the first.  One word in five is no copy, so lines of few words have no
neighbours; where they are equal (``exact_words``) they repeat all the same.

Before that, lines that cannot have a neighbour are set aside: two lines with
at most m words that differ by one word share the first half or the last half
of m - 1 words, so a line emits four half keys and goes on only if another
line has one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthtab.llm.common import drop_stage, free_name, join_cells, write_stage

#: Shorter lines have no neighbours: one word in five is no copy.
MIN_WORDS = 6
#: Lines of any length but empty ones, for ``exact_words``.
ANY_LINE = 1
#: Words of a line whose running sums are made in one array.
PIECE = 32
ID = ["id_a", "id_b"]


def words_of(line: Column) -> Column:
    # One blank is no regular expression, and few lines have other white space.
    others = "\t\x0b\x0c\r"
    some = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    blank = F.when(some, F.translate(line, others, "    ")).otherwise(line)
    words = F.split(F.lower(blank), " ")
    loose = F.contains(blank, F.lit("  ")) | F.startswith(blank, F.lit(" ")) | F.endswith(blank, F.lit(" ")) | (blank == "")
    return F.when(loose, F.filter(words, lambda w: w != "")).otherwise(words)


#: Place of a line as one number: doc_id, line number and 8 digits of its row's hash; a null doc_id comes first.
NO_DOC = "-9223372036854775809"


def place_of() -> Column:
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(NO_DOC).cast("decimal(19,0)"))
    rest = F.col("line_no").cast("long") * 100_000_000 + F.pmod("row_no", F.lit(100_000_000))
    return (doc * F.lit("1000000000000000000").cast("decimal(19,0)") + rest.cast("decimal(19,0)")).cast("decimal(38,0)")


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, row_no, line_no, place, words, id_a, id_b`` of every line with enough words; ``row_no`` tells rows with one doc_id apart."""
    # The hash is taken before rows are made, once a text and not once a line.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_no"), F.split("text", "\n").alias("lines"))
    rows = rows.select("doc_id", "row_no", F.posexplode("lines").alias("line_no", "line"))
    rows = rows.withColumn("words", words_of(F.col("line"))).where(F.size("words") >= min_words).drop("line")
    return rows.withColumns({"place": place_of(), "id_a": F.xxhash64("words"), "id_b": F.xxhash64(F.lit(7), "words")})


def half_keys(words: Column) -> list[Column]:
    """The first and the last half of m - 1 words, for m as many words as the line has, and one more."""
    size = F.size(words)

    def pair(m: Column) -> list[Column]:
        head = F.floor((m - 1) / 2).cast("int")
        tail = (m - 1 - head).cast("int")
        first, last = F.slice(words, F.lit(1), head), F.slice(words, size - tail + 1, tail)
        return [F.xxhash64(F.lit(side), m, part) for side, part in ((1, first), (2, last))]

    return [*pair(size), *pair(size + 1)]


def term(n: int, word: Column, place: Column) -> Column:
    """A 34-bit hash of a word at a place: sums of these do not overflow below 2^29 words."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(n), word, place.cast("int")), 30)


def variants_of(lines: DataFrame) -> DataFrame:
    """``variant, k, place``: each line whole (k = -1), and without each of its words.

    A variant is named by two sums over its words and their places, where the
    words behind the one left out move up by one.  With ``moved`` as a word's
    term in the place before its own, and ``gain`` as what its own place adds
    to that, the sum without word k is all ``moved``, less that of k, and the
    gains of the words before it.  These are running sums: inside pieces of
    ``PIECE`` words in an array, over the pieces of a line by a window.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PIECE).cast("int"))
    # The words are cut before rows are made, so that no row carries a whole long line.
    pieces = F.transform(starts, lambda c: F.slice("words", c * PIECE + 1, F.lit(PIECE)))
    rows = lines.select("place", F.size("words").alias("size"), F.posexplode(pieces).alias("piece", "part"))

    def both(w: Column, i: Column) -> Column:
        at = F.col("piece") * PIECE + i
        moved = [term(n, w, at - 1) for n in (1, 2)]
        return F.struct(*(x.alias(c) for x, c in zip(moved, ("m1", "m2"))), *(term(n, w, at).alias(c) for n, c in ((1, "t1"), (2, "t2"))))

    def step(s: Column, x: Column) -> Column:
        one, two = s["g1"], s["g2"]
        left = F.struct((one - x["m1"]).alias("a"), (two - x["m2"]).alias("b"))
        return F.struct(
            (one + x["t1"] - x["m1"]).alias("g1"), (two + x["t2"] - x["m2"]).alias("g2"),
            (s["m1"] + x["m1"]).alias("m1"), (s["m2"] + x["m2"]).alias("m2"), F.array_append(s["left"], left).alias("left"),
        )

    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    start = F.struct(*(zero.alias(c) for c in ("g1", "g2", "m1", "m2")), empty.alias("left"))
    rows = rows.select("place", "size", "piece", F.transform("part", both).alias("terms"))
    rows = rows.select("place", "size", "piece", F.aggregate("terms", start, step).alias("s")).select("place", "size", "piece", "s.*")
    whole = W.partitionBy("place")
    before = whole.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"all{i}": F.sum(f"m{i}").over(whole) for i in (1, 2)} | {f"off{i}": F.coalesce(F.sum(f"g{i}").over(before), zero) for i in (1, 2)})
    # The whole line, all terms, comes along with its last piece.
    line = F.struct(F.lit(-1).alias("k"), (F.col("all1") + F.col("off1") + F.col("g1")).alias("a"), (F.col("all2") + F.col("off2") + F.col("g2")).alias("b"))
    last = F.col("piece") == F.floor((F.col("size") - 1) / PIECE)

    def sums(v: Column, i: Column) -> Column:
        return F.struct((F.col("piece") * PIECE + i).alias("k"), (F.col("all1") + F.col("off1") + v["a"]).alias("a"), (F.col("all2") + F.col("off2") + v["b"]).alias("b"))

    made = F.transform("left", sums)
    out = rows.select("place", "size", F.explode(F.when(last, F.array_append(made, line)).otherwise(made)).alias("v"))
    length = F.col("size") - F.when(F.col("v.k") < 0, 0).otherwise(1)
    return out.select(F.xxhash64(length, F.col("v.a"), F.col("v.b")).alias("variant"), F.col("v.k").alias("k"), "place")


def neighbours(lines: DataFrame) -> tuple[DataFrame, str]:
    """``place, other``: the earliest line within one word of a line and before it, where there is one; staged.

    ``lines``: ``place, words``, one row for each distinct line.
    """
    rows, rows_path = write_stage(variants_of(lines), "line-variants")
    cells = rows.groupBy("variant", "k").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    same = W.partitionBy("variant")  # as many rows as a line has words
    whole, cut = (F.min(F.when(c, F.col("first"))).over(same) for c in (F.col("k") < 0, F.col("k") >= 0))
    # A whole line meets lines with one word more; a variant meets those with the same word left out, and the whole line.
    other = F.when(F.col("k") < 0, cut).otherwise(F.least("first", whole))
    cells = cells.withColumn("other", other).where("other < last").select("variant", "k", "other")
    cells, path = write_stage(cells, "line-cells")
    found = join_cells(rows, cells, ["variant", "k"]).where("other < place")
    found = found.groupBy("place").agg(F.min("other").alias("other"))
    two = lines.select(F.col("place").alias("other"), F.col("words").alias("two"))
    pairs = found.join(lines.select("place", F.col("words").alias("one")), "place").join(two, "other")
    found, found_path = write_stage(pairs.where(within_one_word(F.col("one"), F.col("two"))).select("place", "other"), "lines-found")
    drop_stage(lines.sparkSession, rows_path, path)
    return found, found_path


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two word lists have an edit distance of at most 1: all words but one of the longer lie in the common ends."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def equal_start(x: Column, y: Column) -> Column:
        same = F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda p, q: p == q)
        first = F.array_position(same, False)
        return F.when(first == 0, least).otherwise(first - 1)

    return equal_start(a, b) + equal_start(F.reverse(a), F.reverse(b)) >= most - 1


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """``doc_id, row_no, line_no, of_doc, of_line, near``: every line to drop, and the earliest line it repeats.

    Lines are ordered by doc_id (null first), a hash of the text, and number.
    Lines of ``exact_words`` words or more (``min_words`` where not given) are
    dropped if equal to an earlier one, lines of ``min_words`` or more also if
    within one word of an earlier one of as many.  Empty lines and null texts
    are never dropped; repeated rows repeat each other's lines, and as they are
    alike in every column read, both keep the same.
    """
    spark = docs.sparkSession
    lines = lines_of(docs, min_words if exact_words is None else max(ANY_LINE, min(exact_words, min_words)))
    enough = F.size("words") >= min_words
    halves = [F.when(enough, h).alias(f"half{i}") for i, h in enumerate(half_keys(F.col("words")))]
    lines, lines_path = write_stage(lines.select("doc_id", "row_no", "line_no", "place", *ID, *halves), "lines")
    names = [f"half{i}" for i in range(len(halves))]
    # The halves follow from the words, so any of a line's rows has them.
    distinct = lines.groupBy(*ID).agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *(F.min(h).alias(h) for h in names))
    distinct, distinct_path = write_stage(distinct, "lines-distinct")
    half = distinct.where(F.col(names[0]).isNotNull()).select("id_a", F.explode(F.array(*names)).alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared, shared_path = write_stage(shared, "lines-halves")
    asked = join_cells(half, shared, ["half"]).select("id_a").distinct()
    asked = distinct.join(asked.hint("merge"), "id_a", "left_semi").select("place")
    # The words of those lines, from the document where each comes first.
    # Shuffles at any size: what is small here is not where texts are many.
    wanted = lines.join(asked.hint("merge"), "place", "left_semi").groupBy("doc_id", "row_no").agg(F.collect_set(F.struct("line_no", "place")).alias("wanted"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_no"), "text")
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["row_no"] == wanted["row_no"])
    # A text is cut into lines once, not once for each of them that is wanted.
    near = rows.join(wanted.hint("merge"), same).select(F.split("text", "\n").alias("lines"), "wanted")
    near = near.select("lines", F.explode("wanted").alias("w")).select("w.place", words_of(F.get("lines", F.col("w.line_no"))).alias("words")).dropDuplicates(["place"])
    near, near_path = write_stage(near, "lines-near")
    found, found_path = neighbours(near)
    told = distinct.select(*ID, "place", "n").join(found.hint("merge"), "place", "left").where("n > 1 or other is not null")
    told, told_path = write_stage(told.select(*ID, F.col("place").alias("first"), "other"), "lines-told")
    met = join_cells(lines.select("doc_id", "row_no", "line_no", "place", *ID), told, ID)
    of = F.coalesce(F.least("other", "first"), F.col("first"))
    met = met.where("place <> first or other is not null").withColumn("of", of)
    doc = F.floor(F.col("of") / F.lit("1000000000000000000").cast("decimal(19,0)")).cast("decimal(20,0)")
    line = F.floor(F.pmod("of", F.lit("1000000000000000000").cast("decimal(19,0)")) / 100_000_000).cast("int")
    doc = F.when(doc != F.lit(NO_DOC).cast("decimal(20,0)"), doc).cast("long")
    out = met.select("doc_id", "row_no", "line_no", doc.alias("of_doc"), line.alias("of_line"), F.col("other").isNotNull().alias("near"))
    drop_stage(spark, distinct_path, shared_path, near_path, found_path)
    return out


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """``doc_id, n_dropped, dropped, of_docs`` of every document that loses lines: their numbers, and where they stand first.

    Documents that lose none (null and empty texts too) have no row; a null id
    is an id and comes first; rows alike in id and text share one row; of equal
    lines the earliest stays; lines of any length are compared.
    """
    dropped = repeated_lines(docs, min_words, exact_words)
    grouped = dropped.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_set(F.struct("line_no", "of_doc"))).alias("lines"))
    return grouped.select("doc_id", F.size("lines").alias("n_dropped"), F.col("lines.line_no").alias("dropped"), F.array_sort(F.array_distinct("lines.of_doc")).alias("of_docs"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``; a document of nothing but repeated lines is dropped.

    All columns stay, ``n_chars`` (where there is one) follows the text.
    Documents that lose nothing are unchanged, null and empty texts included.
    """
    of_doc, of_row, gone, own = (free_name(docs, x) for x in ("gone_doc", "gone_row", "gone", "gone_text"))
    dropped = repeated_lines(docs, min_words, exact_words).groupBy("doc_id", "row_no").agg(F.collect_set("line_no").alias(gone))
    dropped = dropped.select(F.col("doc_id").alias(of_doc), F.col("row_no").alias(of_row), gone)
    rows = docs.withColumn(own, F.xxhash64("text"))
    met = rows.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col(of_doc)) & (F.col(own) == F.col(of_row)), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    left = F.array_join(kept, "\n")
    met = met.where(F.col(gone).isNull() | left.rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return met.withColumns(new).select(*docs.columns)
