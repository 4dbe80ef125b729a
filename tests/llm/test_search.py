import math
import random
import re

import numpy as np
import pytest

from synthtab.llm import lexical_search
from synthtab.session import staging

from .conftest import sentence

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, top=10):
    docs = [(doc_id, terms(text)) for doc_id, text in rows]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item_id, text in items:
        found = []
        for doc_id, t in docs:
            score = 0
            for x in set(terms(text)) & set(t):
                w, tf, m = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))), t.count(x), 10 + 90 * len(t) * n_docs // n_terms
                score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if null else doc, -score) for i, (score, null, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def found(spark, make, rows, items, **more):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    with staging(spark):
        return sorted(map(tuple, lexical_search.search(make(rows), table, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_odd_texts(spark, make, odd):
    items = [(1, "one two THREE"), (1, "a b c d"), (2, None), (3, ""), (4, "... !"), (5, "nowhere-to-be-found"), (6, "straße 日本語 ba ko"), (None, "text id"), (1, "a b c d")]
    assert found(spark, make, odd, items) == brute(odd, items)
    assert found(spark, make, [], items) == [] and found(spark, make, odd, []) == []
    assert found(spark, make, [(1, None), (2, "")], items) == []


@pytest.mark.parametrize(("docs", "entries", "window", "short", "item_bytes"), [(1 << 15, 1 << 20, 1 << 11, 16, 1 << 20), (50, 400, 8, 4, 300), (64, 1 << 20, 16, 1 << 30, 1 << 20), (300, 1 << 20, 32, 1, 1 << 20)])
def test_every_mixture_of_short_and_long_lists(spark, make, monkeypatch, docs, entries, window, short, item_bytes):
    for name, value in {"SEGMENT_DOCS": docs, "SEGMENT_ENTRIES": entries, "WINDOW": window, "SHORT": short}.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    weight = [1 / (i + 1) for i in range(120)]
    rows = [(rng.randrange(400), " ".join(rng.choices(words, weight, k=rng.randint(0, 40)))) for _ in range(500)] + [(None, "w5 w90"), (None, "w5 w90")]
    rows += [(1000 + i, "w100 w1 w7") for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(99, "w100 w1")]
    assert found(spark, make, rows, items, item_bytes=item_bytes) == brute(rows, items)


def test_windows_are_skipped():
    """A window whose bounds cannot reach the least score is not looked at."""
    n = 8 * lexical_search.WINDOW
    place, tfs = np.arange(n), np.ones(n, np.int64)
    tfs[5] = 50
    segment = lexical_search.Segment(np.zeros(n, np.int64), tfs, place, np.full(n, 100), np.array([500]), n, 100 * n)
    places, scores = segment.search(np.array([0]), 1, 1)
    assert places.tolist() == [5] and scores[0] == segment.adds[5]
    assert (segment.most[0] < scores[0]).sum() == 7
    assert segment.search(np.array([0]), int(scores[0]) + 1, 1)[0].tolist() == []


def test_terms_at_word_edges(spark, make):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 12) + rng.choice(["\x7f", "`", "{", "_", "-", " ", "@"]) + "Tail9é") for i in range(30)]
    items = [(1, "tail9é"), (2, "TAIL9É"), (3, rows[4][1])]
    assert found(spark, make, rows, items) == brute(rows, items)
