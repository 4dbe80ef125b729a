import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from synthtab.llm import source_audit
from synthtab.session import staging

from .conftest import sentence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if df[t] >= 3) for s in sources}
        everything = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count.values())
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[s]) for s in sources}
        q = shares(everything)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, top=200, parts=4):
    schema = "doc_id long, text string, lang string, source string, term string, count long, digest string, at int"
    docs = spark.createDataFrame([(i % 7, *r, "x", 1, "y", 2) for i, r in enumerate(rows)], schema).repartition(parts)
    with staging(spark):
        return sorted(map(tuple, source_audit.source_audit(docs, top).collect()))


@pytest.mark.parametrize(("tile", "block", "held"), [(512, 1 << 20, 300_000), (2, 7, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, tile, block, held):
    for name, value in {"TILE": tile, "BLOCK": block, "HELD": held}.items():
        monkeypatch.setattr(source_audit, name, value)
    rng = random.Random(8)
    rows = [(sentence(rng, rng.randint(0, 20)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "ß", "t", None])) for _ in range(150)]
    rows += [(rows[3][0], "en", rng.choice(["s0", "s1"])) for _ in range(60)]  # one text, two sources
    rows += [(rows[3][0], "de", "s0")] * 5
    rows += [(None, "fr", "s0"), ("", "fr", "s1"), ("only one", "xx", "s0"), ("12 3", "en", "bare"), ("É é STRASSE straße x", "xx", "s0"), (" ".join(["long"] * 20_000), "xx", "s1")] * 2
    found = audited(spark, rows, top=15)
    assert found == brute(rows, top=15)
    assert ("fr", "s0", "pair", "s1", 0, 1) in found


def test_no_rows(spark):
    assert audited(spark, [("a b c", "en", "s")])[:1] == [] and audited(spark, [("a", "en", "s")] * 0 + [(None, None, None)]) == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    with staging(spark):
        assert source_audit.source_audit(docs).collect() == []


def test_equal_texts_are_cut_into_terms_once(spark, make):
    rows = [(i, "same text", "en") for i in range(50)] + [(60, "same text", "de"), (61, "other", "en")]
    docs = make(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    found = {(r["lang"], r["text"].decode()): dict(map(tuple, r["sources"])) for r in source_audit.collapsed(docs).collect()}
    assert found == {("en", "same text"): {"a": 17, "b": 33}, ("de", "same text"): {"a": 1}, ("en", "other"): {"b": 1}}


def test_counts_beyond_64_bits_are_exact(spark):
    row = spark.createDataFrame([(3 * 10**11, 10**13, 10**6)], "c long, n long, v long")
    assert row.select(F.expr(source_audit.share("c", "n", "v"))).first()[0] == 1 + 10**9 * (3 * 10**11 + 1) // (10**13 + 10**6)
