"""How the sources of a language differ in their words, with equal texts collapsed first.

Texts that are equal within a language are one row with the number of its
documents in each source.  A text is cut into terms once, and its counts and
document frequencies are added that many times.  Sources are then compared by
sparse sums: what two sources owe to terms that only one of them has follows
from how often each of its counts occurs, so only terms that both have are
looked at as pairs, in blocks inside the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthtab.llm.common import slices, write_stage

#: Documents of a language that a term needs.
LEAST_DOCS = 3
#: Terms reported for each group.
TOP_TERMS = 200
UNIT = 1_000_000_000
#: Sums held by a task before they are passed on, and rows of a batch that it passes on.
HELD = 1_500_000
ROWS = 1 << 16
SLICE = 4 << 20
#: Sources compared with one another at once, and the cells of a block of terms.
TILE = 512
BLOCK = 1 << 20
#: What ends a term: ASCII but letters.  Other bytes stand for themselves, A-Z for a-z.
TURN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and other than ASCII characters, A-Z lower-cased."""
    return text.translate(TURN).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, text, sources``: each text of a language once, with the number of its rows in each source.

    Texts travel once, and only one copy from each task; the rows are counted
    by digest.  Both sides are dealt by language and digest, so they meet
    without another shuffle.
    """
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*plain).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    counts = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    sources = counts.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = rows.groupBy("lang", "digest").agg(F.first(F.col("text").cast("binary")).alias("text"))
    return texts.join(sources.hint("merge"), ["lang", "digest"]).select("lang", "text", "sources")


class Sums:
    """Counts and documents of the terms of (language, source) groups, added up in arrays."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.held = np.zeros((3, 0), np.int64)  # group and term as one number, count, documents

    def add(self, texts: list[bytes], langs: list[str], sources: list[list[dict]]) -> None:
        number, groups, terms = self.terms.setdefault, self.groups, self.terms
        ids: list[int] = []
        counts: list[int] = []
        rows: list[tuple[int, int, int]] = []
        for text, lang, own in zip(texts, langs, sources):
            found = Counter(terms_of(text))
            for x in own:
                ids.extend([number(t, len(terms)) for t in found])
                counts.extend(found.values())
                rows.append((groups.setdefault((lang, x["source"]), len(groups)), x["n"], len(found)))
        group, n, size = np.array(rows, np.int64).reshape(-1, 3).T
        group, n = np.repeat(group, size), np.repeat(n, size)
        new = np.stack([group << 40 | np.array(ids, np.int64), np.array(counts, np.int64) * n, n])
        both = np.concatenate([self.held, new], axis=1)
        both = both[:, np.argsort(both[0], kind="stable")]
        first = np.flatnonzero(np.append(True, both[0, 1:] != both[0, :-1])[: both.shape[1]])
        self.held = np.stack([both[0, first], *(np.add.reduceat(x, first) if len(first) else x for x in both[1:])])

    def rows(self) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        terms = pa.array([t.decode("utf-8", "replace") for t in self.terms], pa.string())
        for low in range(0, self.held.shape[1], ROWS):
            key, count, docs = self.held[:, low : low + ROWS]
            group = pa.array(key >> 40)
            columns = [langs.take(group), sources.take(group), terms.take(pa.array(key & (1 << 40) - 1)), pa.array(count), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of ``collapsed`` rows, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sums.add(*(batch.column(c).to_pylist() for c in ("text", "lang", "sources")))
                if max(sums.held.shape[1], len(sums.terms)) > HELD:
                    yield from sums.rows()
                    sums = Sums()
        yield from sums.rows()

    made = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> str:
    """SQL of ``1 + floor(10^9 (count + 1) / (total + terms))``, exact at any count; null without terms."""
    return f"1 + cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div nullif(cast({total} + {terms} as decimal(20,0)), 0)"


def distance(p: str, q: str) -> str:
    """SQL of ``floor((p - q)^2 / q)`` in 64 bits: a share is under 2^31."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def kept_cells(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, lang_count`` of the terms that enough documents of a language have; staged."""
    # A term has at most one row for each source here, however frequent it is.
    term = W.partitionBy("lang", "term")
    sums = {"lang_count": F.sum("count").over(term), "lang_docs": F.sum("docs").over(term)}
    cells = term_counts(collapsed(docs)).withColumns(sums).where(F.col("lang_docs") >= LEAST_DOCS)
    return write_stage(cells.select("lang", "source", "term", "count", "lang_count"), "audit-cells")[0]


def group_totals(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, source, at, total, lang_total, terms, zero``: one row for each group; ``at`` numbers the sources of a language, ``zero`` is the share of a term it lacks; staged."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    # Every row of a term carries its count in the language: the first source has it counted once.
    once = cells.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("total", "lang_total", "terms")}
    out = groups.join(totals, ["lang", "source"], "left").join(once, "lang", "left").withColumns(zeros)
    out = out.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    return write_stage(out.withColumn("zero", F.expr(share("0", "total", "terms"))), "audit-groups")[0]


def joint_sums(shares: DataFrame) -> DataFrame:
    """``lang, a, b, value``: what terms of both sources add to what each of them adds alone.

    ``shares``: ``lang, term, at, sources, p, zero``.  Sources are compared tile by tile,
    so a block of terms by sources is bounded in size, and a task passes on
    sums only.
    """
    tiles = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE).cast("int"))
    rows = shares.withColumn("tile", F.floor(F.col("at") / TILE).cast("int")).withColumn("other", F.explode(tiles))
    rows = rows.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")})
    rows = rows.groupBy("lang", "term", "one", "two").agg(F.collect_list(F.struct("at", "p", "zero")).alias("has")).where(F.size("has") > 1)

    def sums_of(p: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Sum over the rows (terms) of ``p`` (0: the source lacks it), for each pair of columns."""
        out = np.zeros((p.shape[1], p.shape[1]), np.int64)
        base = (zero[:, None] - zero) ** 2 // zero
        for a in range(p.shape[1]):
            some = p[:, a] > 0
            mine, all_p = p[some, a, None], p[some]
            q = np.where(all_p > 0, all_p, 1)
            value = (mine - q) ** 2 // q - (mine - zero) ** 2 // zero - (zero[a] - q) ** 2 // q + base[a]
            out[a] = np.where(all_p > 0, value, 0).sum(axis=0)
        np.fill_diagonal(out, 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], dict[tuple[int, int], int]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, _, _), sums in held.items():
                a, b = np.array(list(sums), np.int32).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(a), pa.array(b), pa.array(sums.values(), pa.int64())], ["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            one, two = (batch.column(c).to_numpy() for c in ("one", "two"))
            has = batch.column("has")
            ends, cells = has.offsets.to_numpy(), has.flatten()
            ends = ends - ends[0]
            at, p, zero = (cells.field(c).to_numpy() for c in ("at", "p", "zero"))
            term = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for key in set(zip(langs.tolist(), one.tolist(), two.tolist())):
                mine = (langs == key[0]) & (one == key[1]) & (two == key[2])
                cell = np.flatnonzero(mine[term])
                names, column = np.unique(at[cell], return_inverse=True)
                zeros = np.ones(len(names), np.int64)
                zeros[column] = zero[cell]
                lines = np.unique(term[cell], return_inverse=True)[1]
                step = max(1, BLOCK // len(names))
                sums = held.setdefault(key, {})
                for low in range(0, lines.max() + 1, step):
                    part = slice(*np.searchsorted(lines, [low, low + step]))
                    dense = np.zeros((min(step, lines.max() + 1 - low), len(names)), np.int64)
                    dense[lines[part] - low, column[part]] = p[cell[part]]
                    found = sums_of(dense, zeros)
                    for a, b in zip(*np.nonzero(found)):
                        # Pairs of two tiles only meet here if they lie in both.
                        if key[1] == key[2] or (names[a] // TILE) != (names[b] // TILE):
                            pair = int(names[a]), int(names[b])
                            sums[pair] = sums.get(pair, 0) + int(found[a, b])
            if sum(map(len, held.values())) > HELD:
                yield from passed()
        yield from passed()

    return rows.select("lang", "one", "two", "has").mapInArrow(run, "lang string, a int, b int, value long")


def source_audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others, and by which terms.

    Part ``pair``: each other source of the language, by the sum over all kept
    terms.  Part ``term``: the ``top`` terms that the source has above its
    language's share.  Greater values first, equal ones by item.  Null lang,
    source and text count as empty; a group without terms has pairs and no
    terms; repeated rows are documents of their own; an empty table gives no rows.
    """
    cells = kept_cells(docs)
    groups = group_totals(docs, cells)
    known = cells.join(groups, ["lang", "source"])
    known = known.withColumns({"p": F.expr(share("count", "total", "terms")), "q": F.expr(share("lang_count", "lang_total", "terms"))})
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    number = groups.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("sources"))
    joint = joint_sums(known.join(number, "lang").select("lang", "term", "at", "sources", "p", "zero"))
    # What a source adds to a pair by itself follows from how often each of its shares occurs.
    own = known.groupBy("lang", "at", "p", "zero").agg(F.count(F.lit(1)).alias("n"))
    names = ["lang", F.col("at").alias("b"), F.col("zero").alias("zero_b"), F.col("source").alias("item")]
    met = own.withColumnsRenamed({"at": "a"}).join(groups.select(*names), "lang").where("a <> b")
    base, turned = distance("zero", "zero_b"), distance("zero_b", "zero")
    first = met.select("lang", "a", "b", F.expr(f"n * ({distance('p', 'zero_b')} - {base})").alias("value"))
    second = met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.expr(f"n * ({distance('zero_b', 'p')} - {turned})").alias("value"))
    sums = joint.unionByName(first).unionByName(second)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("more"))
    pairs = groups.select("lang", "source", F.col("at").alias("a"), "zero", "terms").join(groups.select(*names), "lang").where("a <> b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left")
    least = F.coalesce(F.expr(f"cast(terms as decimal(19,0)) * cast({base} as decimal(19,0))"), F.lit(0))
    value = (least + F.coalesce("more", F.lit(0))).cast("long")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(best))
    return pair.unionByName(term)
