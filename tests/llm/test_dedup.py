import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthtab.llm import common, components, exact_dedup, line_dedup, near_dup, shingles, substring_dedup

from .conftest import sentence

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_hot_keys_are_cut_into_several_tasks(spark):
    rows = spark.range(0, 200_000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    cells, _ = common.write_stage(rows.groupBy("k").agg(F.min("id").alias("least")), "test-cells")
    names = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in zip(names, ("16k", "1.5", "16k")):
            spark.conf.set(n, value)
        joined = common.join_cells(rows, cells, ["k"])
        assert len(joined.collect()) == 200_000 and joined.where("least > id").count() == 0
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    named = spark.createDataFrame([*links, (None, 1), (5, None)], "a long, b long")
    parts, _ = components.connected(named)
    found = {r["v"]: r["component"] for r in parts.collect()}
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components.connected(named.limit(0))[0].collect() == []


def exact_brute(rows):
    norm = [SPACE.sub(" ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        same = [j for (j, _), u in zip(rows, norm) if u == t]
        keep = min((j for j in same if j is not None), default=None)
        out.append((key(i), key(keep), len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_exact_groups(make, odd):
    rng = random.Random(2)
    base = sentence(rng, 400)
    rows = [*odd, *((100 + i, base[: 60 + 70 * i]) for i in range(20)), *((200 + i, base + " " * (i % 2) + f"{i // 4}") for i in range(16)), *((300 + i, "hot text") for i in range(1500))]
    found = exact_dedup.exact_groups(make(rows)).collect()
    assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in found) == exact_brute(rows)
    assert exact_dedup.exact_groups(make([])).collect() == []


def shingle_brute(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_shingles(odd):
    texts = [(t or "").encode() for _, t in odd]
    for k in (1, 4, 5):
        sets = shingles.shingle_sets(texts, k)
        true = [shingle_brute(t, k) for _, t in odd]
        assert [len(s) for s in sets] == [len(s) for s in true]
        for i in range(len(sets)):
            for j in range(i):
                assert len(np.intersect1d(sets[i], sets[j])) == len(true[i] & true[j])


def near_brute(rows, k, percent):
    sets = [shingle_brute(t, k) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    old, new = part[i], part[j]
                    part = [new if p == old else p for p in part]
    out = []
    for n, (i, _) in enumerate(rows):
        name = i if not sets[n] or i is None else min(rows[m][0] for m in range(len(rows)) if part[m] == part[n] and sets[m])
        out.append((key(i), len(sets[n]), key(name), i == name))
    return sorted(out)


def mutated(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


@pytest.mark.parametrize("block", [near_dup.BLOCK_BYTES, 10_000])
def test_near_groups(make, odd, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", block)
    rng = random.Random(9)
    rows = list(odd)
    passage = sentence(rng, 60)
    for g in range(12):
        base = sentence(rng, rng.randint(60, 200))
        rows += [(1000 + 50 * g + c, mutated(rng, base, rng.randint(0, 4))) for c in range(12)]
    rows += [(5000 + i, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}") for i in range(60)]
    # A chain: each is near the next, the ends are far apart.
    words = sentence(rng, 200).split()
    for i in range(12):
        rows.append((6000 + i, " ".join(words)))
        words[i * 16 : i * 16 + 5] = sentence(rng, 5).split()
    found = near_dup.near_groups(make(rows), words=4, percent=80).collect()
    assert sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"]), r["kept"]) for r in found) == near_brute(rows, 4, 80)


def test_a_dense_group_is_never_written_as_pairs(make, monkeypatch):
    """Thousands of members at a similarity of 0.7 to 0.8, few of them linked: rows stay in proportion to the members."""
    rng = random.Random(13)
    n, length = 3000, 203
    base, members, texts = [f"b{i}" for i in range(length)], np.zeros((n, length - 3), np.int64), []
    for i in range(n):
        words, whole = list(base), np.ones(length, bool)
        for place in rng.sample(range(4, length - 4), rng.choice([3, 4, 4, 5])):
            words[place], whole[place] = f"x{i}-{place}", False
        members[i] = whole[:-3] & whole[1:-2] & whole[2:-1] & whole[3:]
        texts.append((i, " ".join(words)))
    both = members @ members.T  # a changed word is in no other text
    links = 100 * both >= 80 * (2 * (length - 3) - both)
    share = (both / (2 * (length - 3) - both))[np.triu_indices(n, 1)]
    assert 0.7 < np.median(share) < 0.8
    part = np.arange(n)
    while (new := np.where(links, part, n).min(axis=1)).tolist() != part.tolist():
        part = new
    staged = {}

    def spy(df, name, real=near_dup.write_stage):
        out = real(df, name)
        staged[name] = max(staged.get(name, 0), out[0].count())
        return out

    monkeypatch.setattr(near_dup, "write_stage", spy)
    found = near_dup.near_groups(make(texts), words=4, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(part.tolist()))
    assert staged["near-partners"] <= near_dup.POSITIONS * n and staged["near-links"] <= 4 * n


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, near_dup.POSITIONS)).astype(np.uint16)
        b = a.copy()
        wrong = rng.choice(near_dup.POSITIONS, rng.integers(0, near_dup.DISTANCE + 1), replace=False)
        b[0, wrong] ^= 1
        assert (near_dup.index_keys(a) == near_dup.index_keys(b)).any()


@pytest.mark.parametrize("size", [1, 5, 40, 150, 600, 5000])
def test_sketch_keeps_similar_sets(size):
    rng = np.random.default_rng(size)
    kept = 0
    for _ in range(200):
        one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        shared = rng.permutation(one)[: max(1, -(-len(one) * 8 // 9))]
        extra = rng.integers(0, 1 << 63, max(0, len(shared) * 5 // 4 - len(one))).astype(np.uint64)
        other = np.unique(np.concatenate([shared, extra]))
        both = len(np.intersect1d(one, other))
        if 100 * both >= 80 * (len(one) + len(other) - both):
            a, b = (np.frombuffer(near_dup.sketch_of(x), np.uint8) for x in (one, other))
            kept += 1
            assert near_dup.likely(a, b[None], np.array([len(other)]), len(one), 80)[0]
    assert kept
    far = np.frombuffer(near_dup.sketch_of(rng.integers(0, 1 << 63, size).astype(np.uint64)), np.uint8)
    assert not near_dup.likely(a, far[None], np.array([size]), size, 80)[0]


def test_without_near_duplicates(make, odd):
    rows = [*odd, (50, "a b c d e f g h i j"), (51, "A b c d e f g h i j")]
    kept = near_dup.without_near_duplicates(make(rows))
    assert kept.columns == make(rows).columns
    ids = sorted(key(r["doc_id"]) for r in kept.collect())
    assert 50 in ids and 51 not in ids and 7 not in ids and {-1, 1, 2, 3, 6, 9} <= set(ids)
    assert near_dup.near_groups(make([])).collect() == []


def one_word_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def lines_brute(rows, least, exact=None):
    lines = [(i, n, x.lower().split()) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in sorted(lines, key=lambda x: (key(x[0]), x[1])) if len(x[2]) >= (exact or least)]
    first, dropped = {}, set()
    for i, n, words in lines:
        first.setdefault(tuple(words), (key(i), n))
    heads = [w for w in first if len(w) >= least]
    bad = {w for w in heads if any(first[o] < first[w] and o != w and one_word_apart(list(o), list(w)) for o in heads)}
    for i, n, words in lines:
        if tuple(words) in bad or first[tuple(words)] != (key(i), n):
            dropped.add((key(i), n))
    return dropped


@pytest.mark.parametrize(("piece", "exact"), [(line_dedup.PIECE, None), (3, line_dedup.ANY_LINE), (1, None)])
def test_repeated_lines(make, monkeypatch, piece, exact):
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    rng = random.Random(6)
    pool = [sentence(rng, rng.randint(3, 14)) for _ in range(60)]
    pool += ["the the the the the the the", "the the the the the the", "the the the a the the the", "Ä b c d e f", "ä b c d e f", "b c d e f g h\tx"]
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, pool[0]), (4, sentence(rng, 2000))]
    for d in range(80):
        chosen = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(pool).split(" ")
            kind = rng.random()
            if kind < 0.2:
                words[rng.randrange(len(words))] = "new"
            elif kind < 0.3:
                words.insert(rng.randrange(len(words) + 1), "more")
            elif kind < 0.4:
                del words[rng.randrange(len(words))]
            chosen.append("  ".join(words).title() if kind > 0.9 else " ".join(words))
        rows.append((10 + d, "\n".join(chosen)))
    docs = make(rows)
    found = line_dedup.repeated_lines(docs, exact_words=exact).collect()
    expected = lines_brute(rows, line_dedup.MIN_WORDS, exact)
    assert {(key(r["doc_id"]), r["line_no"]) for r in found} == expected
    assert all((key(r["of_doc"]), r["of_line"]) < (key(r["doc_id"]), r["line_no"]) for r in found)
    report = {key(r["doc_id"]): r["dropped"] for r in line_dedup.line_report(docs, exact_words=exact).collect()}
    assert {(i, n) for i, lines in report.items() for n in lines} == expected
    kept = {key(r["doc_id"]): r["text"] for r in line_dedup.without_repeated_lines(docs, exact_words=exact).collect()}
    for i, t in rows:
        left = None if t is None else [x for n, x in enumerate(t.split("\n")) if (key(i), n) not in expected]
        gone = t is not None and len(left) < len(t.split("\n"))
        if gone and not "".join(left).strip():
            assert key(i) not in kept
        else:
            assert kept[key(i)] == (t if left is None else "\n".join(left))
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert line_dedup.repeated_lines(make([])).collect() == []


def test_long_lines_have_neighbours_too(make):
    """Lines of thousands of words, one word apart at either end, in the middle and at a piece's edge."""
    rng = random.Random(16)
    base = sentence(rng, 5000).split()
    rows = [(1, " ".join(base)), (2, sentence(rng, 5000))]
    for i, at in enumerate((0, 31, 32, 2500, 4999)):
        rows += [(10 + i, " ".join(base[:at] + base[at + 1 :])), (20 + i, " ".join([*base[:at], "new", *base[at:]])), (30 + i, " ".join([*base[:at], "other", *base[at + 1 :]]))]
    rows += [(40, " ".join(base[1:-1])), (41, " ".join(["x", *base[1:-1], "y"]))]
    found = {(r["doc_id"], r["of_doc"], r["near"]) for r in line_dedup.repeated_lines(make(rows)).collect() if r["doc_id"] < 40}
    assert found == {(d + i, 1, True) for d in (10, 20, 30) for i in range(5)}
    two = {r["doc_id"]: r["of_doc"] for r in line_dedup.repeated_lines(make([r for r in rows if r[0] not in (10, 14, 20, 24)])).collect()}
    assert 40 not in two and 41 not in two


def test_line_dedup_of_odd_documents(make, odd):
    kept = line_dedup.without_repeated_lines(make(odd)).collect()
    ids = [key(r["doc_id"]) for r in kept]
    assert {1, 2, 3, 4, 5, 6, 9, -1} <= set(ids) and 7 not in ids and 8 not in ids
    assert next(r["text"] for r in kept if r["doc_id"] == 15).count("\n") == 0


def test_short_lines_that_are_equal(make):
    """Below ``min_words`` equal lines go, lines one word apart stay; exact copies go whole, whatever their lines."""
    unspaced = "日本語の文章はここで終わる。"
    body = f"a line of seven words in all\nAll rights reserved.\n{unspaced}"
    rows = [
        (1, body), (2, body), (3, "all  rights RESERVED.\nnew"), (4, "all rights waived.\nold"), (5, f"{unspaced}\nown words"),
        (6, "own\nown\n\nend"), (7, "one two three four five"), (8, "one two three four five six"), (9, None), (10, ""), (11, "\n"),
        *((100 + i, f"the end\nown line {i}") for i in range(60)),
    ]
    found = {(r["doc_id"], r["line_no"]): (r["of_doc"], r["of_line"], r["near"]) for r in line_dedup.repeated_lines(make(rows), exact_words=line_dedup.ANY_LINE).collect()}
    short = {(3, 0): (1, 1, False), (5, 0): (1, 2, False), (6, 1): (6, 0, False)} | {(100 + i, 0): (100, 0, False) for i in range(1, 60)}
    assert found == {(2, n): (1, n, False) for n in range(3)} | short
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(make(rows), exact_words=line_dedup.ANY_LINE).collect()}
    assert 2 not in kept and kept[1] == body and kept[3] == "new" and kept[5] == "own words" and kept[6] == "own\n\nend"
    assert kept[9] is None and kept[10] == "" and kept[11] == "\n"


def test_registered_line_dedup_takes_short_lines(spark, make, tmp_path):
    from synthtab.llm.queries import op3_line_dedup

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = make([(1, "all rights reserved.\nmine"), (2, "all rights reserved.\nyours")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["doc_id"], r["dropped"]) for r in op3_line_dedup(spark, str(tmp_path)).collect()] == [(2, [0])]
    assert {r["doc_id"]: r["text"] for r in pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == {1: "all rights reserved.\nmine", 2: "yours"}


def test_copies_with_blank_lines_leave_nothing(make):
    body = "the first line of this text is here\n\n\t\n \r\n\nand the last line of this text is here\n"
    kept = line_dedup.without_repeated_lines(make([(1, body), (2, body), (3, "\n\n")])).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: body, 3: "\n\n"}


def test_no_python_in_the_line_plan(make, odd):
    plan = line_dedup.repeated_lines(make(odd))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_gear_hash_and_cuts():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    gear = substring_dedup.gear_hashes(data)
    for i in (0, 3, 15, 16, 4999):
        assert gear[i] == sum(int(substring_dedup.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 65536
    ends = substring_dedup.cuts(data)
    shifted = substring_dedup.cuts(np.append(np.frombuffer(b"inserted text", np.uint8), data))
    assert set(ends[ends > 16]) <= set(shifted - 13)
    assert substring_dedup.cuts(np.zeros(20_000, np.uint8)).tolist()[-1] == 20_000
    assert np.diff(substring_dedup.cuts(np.full(20_000, 65, np.uint8)), prepend=0).max() <= substring_dedup.LONGEST


def test_repeated_passages(make, odd):
    rng = random.Random(8)
    passages = [sentence(rng, 60) for _ in range(10)]
    rows, planted = [], {}
    for d in range(120):
        text = sentence(rng, rng.randint(20, 80))
        if d % 2:
            p = rng.randrange(10)
            text += " " + passages[p] + " " + sentence(rng, rng.randint(5, 50))
            planted[d] = p
        rows.append((d, text))
    found = {r["doc_id"]: r for r in substring_dedup.span_report(make(rows)).collect()}
    first = {}
    for d, p in planted.items():
        first.setdefault(p, d)
    later = {d for d, p in planted.items() if first[p] != d}
    assert len(later & found.keys()) >= 0.97 * len(later) and found.keys() <= later
    for d, r in found.items():
        body = rows[d][1].encode()
        assert all(body[a:b].decode() in passages[planted[d]] or body[a:b].strip().decode() in passages[planted[d]] for a, b in r["spans"])
        assert first[planted[d]] in r["of_docs"]
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_spans(make(rows)).collect()}
    for d, text in rows:
        body = bytearray(text.encode())
        for a, b in reversed(found[d]["spans"] if d in found else []):
            del body[a:b]
        assert cut[d].encode() == bytes(body)
    whole = substring_dedup.without_spans(make(odd))
    assert whole.count() == len(odd) and whole.columns == make(odd).columns
    texts = {key(r["doc_id"]): r["text"] for r in whole.collect()}
    assert texts[1] is None and texts[2] == "" and texts[7] == "" and texts[8].strip() in odd[7][1]
    assert substring_dedup.span_report(make([])).collect() == []


def test_seeds_are_extended_to_the_ends_of_a_passage(make):
    """Passages of just over 50 words: few are missed, and the spans reach from end to end."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))
    passages = [words(51) for _ in range(400)]
    long = [words(600), words(500)]
    rows = [(i, f"{words(15)} . {p} , {words(15)}") for i, p in enumerate(passages)]
    rows += [(1000 + i, f"{words(12)} ; {p} : {words(12)}") for i, p in enumerate(passages)]
    # Parts of these are first elsewhere, so the whole passage is a chain of several sources.
    rows += [(2000, long[0][1500:1900]), (2001, long[0]), (2002, f"{words(9)} ! {long[0]} ? {words(9)}"), (2003, "a" * 9000), (2004, f"{long[1]} - {long[1]}"), (None, "日本語" * 40), (3000, "x" + "日本語" * 40 + "y")]
    spans = {(r["doc_id"], r["start"]): r for r in substring_dedup.repeated_spans(make(rows), extend=True).collect()}
    found = [(i, r) for (d, _), r in spans.items() if d is not None and 1000 <= d < 1400 for i in (d - 1000,)]
    assert len({i for i, _ in found}) >= 0.985 * len(passages)
    bodies = dict(rows)
    exact = [bodies[1000 + i].encode()[r["start"] : r["stop"]].decode().strip() == passages[i] for i, r in found]
    assert np.mean(exact) >= 0.99
    one = [r for (d, _), r in spans.items() if d == 2002]
    assert len(one) == 1 and long[0] in bodies[2002].encode()[one[0]["start"] : one[0]["stop"]].decode()
    assert not {d for d, _ in spans if d is not None and d < 1000}


def maximal_repeats(texts, least):
    """(doc, start, stop) of every longest stretch whose windows of ``least`` bytes all stand earlier, by brute force."""
    seen, out = set(), []
    for doc, body in enumerate(texts):
        windows = [body[i : i + least] for i in range(len(body) - least + 1)]
        again = []
        for window in windows:
            again.append(window in seen)
            seen.add(window)
        start = None
        for i, a in enumerate([*again, False]):
            if a and start is None:
                start = i
            elif not a and start is not None:
                out.append((doc, start, i - 1 + least))
                start = None
    return out


def test_spans_are_all_longest_equal_passages(make):
    """Against brute force: what is found is a whole longest passage (cut to whole words), and few long ones are missed."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    words = lambda n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))
    texts = []
    for _ in range(260):
        body = words(rng.randint(10, 60))
        for _ in range(rng.randint(0, 2)):
            if texts:
                other = rng.choice(texts).split(" ")
                low = rng.randrange(len(other))
                body += " " + " ".join(other[low : low + rng.randint(8, 120)]) + " " + words(rng.randint(1, 20))
        texts.append(body)
    expected = maximal_repeats([t.encode() for t in texts], substring_dedup.MIN_BYTES)
    found = {}
    for r in substring_dedup.repeated_spans(make(list(enumerate(texts))), extend=True).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    met, exact, long, missed = set(), [], 0, 0
    for doc, start, stop in expected:
        body = texts[doc].encode()
        mine = [(a, b) for a, b in found.get(doc, []) if a < stop and b > start]
        met.update((doc, a, b) for a, b in mine)
        if stop - start >= 300:
            long, missed = long + 1, missed + (not mine)
        if mine:
            # Up to whole words.  A seed follows its first place, and now and then a later one goes on for longer.
            a, b = min(mine)[0], max(mine)[1]
            assert start <= a and b <= stop, (doc, start, stop, mine)
            exact.append(body[start:a].count(b" ") <= 1 and body[b:stop].count(b" ") <= 1 and len(mine) == 1)
    assert np.mean(exact) >= 0.85 and met == {(d, a, b) for d, spans in found.items() for a, b in spans}
    assert long > 50 and missed <= 1


def test_rows_with_one_id_are_told_apart(make):
    """Repeated rows are one document; other texts with the same id, or without one, are documents of their own."""
    rng = random.Random(32)
    passage = sentence(rng, 60)
    rows = [(1, f"{sentence(rng, 9)} {passage}"), (2, f"{passage} {sentence(rng, 9)}"), (2, sentence(rng, 80)), (None, f"{sentence(rng, 12)} {passage} x"), (None, sentence(rng, 50))]
    found = substring_dedup.span_report(make(rows + rows[1:4]), extend=True).collect()
    assert sorted(key(r["doc_id"]) for r in found) == [1, 2]
    cut = substring_dedup.without_spans(make(rows), extend=True).collect()
    assert len(cut) == 5 and sum(passage in r["text"] for r in cut) == 1


def test_line_dedup_hashes_a_text_once_and_not_once_a_line(spark):
    from synthtab.llm.line_dedup import lines_of

    docs = spark.createDataFrame([(1, "a b\nc d\na b")], "doc_id long, text string")
    plan = lines_of(docs, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(text" not in plan[: plan.index("Generate")] and "xxhash64(text" in plan
    assert lines_of(docs, 1).select("row_no").distinct().count() == 1
