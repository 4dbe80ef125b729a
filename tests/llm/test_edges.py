"""Very long texts, ties, repeated rows, and the language model against plain loops."""

import math
import random

import numpy as np
import pytest

from synthtab.llm import decontamination, language, url_filter
from synthtab.llm.queries import URL_RULES
from synthtab.session import staging

from .conftest import sentence

SOUNDS = {"aa": ["tor", "lin", "quas"], "bb": ["era", "mou", "chi"], "cc": ["zsc", "ung", "pf"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_prediction(model, text):
    """The same mixture, one word and one language at a time."""
    bucket, word, _ = language.trigrams([text])
    ends = [*word.tolist()[1:], len(bucket)]
    logs = [[sum(model.log[b, j] for b in bucket[a:z].tolist()) for j in range(len(model.languages))] for a, z in zip(word.tolist(), ends)]

    def em(members, start):
        share = dict(zip(members, start))
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(members, 0.0)
            for row in logs:
                part = {j: share[j] * math.exp(row[j] - max(row)) for j in members}
                total = sum(part.values()) + 1e-300
                for j in members:
                    new[j] += part[j] / total
            share = {j: v / len(logs) for j, v in new.items()}
        fit = sum(math.log(sum(share[j] * math.exp(row[j] - max(row)) for j in members) + 1e-300) for row in logs)
        return share, fit

    n = len(model.languages)
    share, _ = em(range(n), [1 / n] * n)
    order = sorted(range(n), key=lambda j: -share[j])
    best, kept = sum(row[order[0]] - max(row) for row in logs), {order[0]: 1.0}
    for k in range(2, n + 1):
        start = [share[j] + 1e-6 for j in order[:k]]
        found, fit = em(order[:k], [s / sum(start) for s in start])
        fit -= 0.5 * (k - 1) * math.log(len(logs) + 1) + math.log(n) * (k - 1)
        if fit <= best:
            break
        best, kept = fit, found
    top = max(kept.values())
    return model.languages[min(j for j, v in kept.items() if v >= top - 1e-9)], top


@pytest.fixture(scope="module")
def model(make):
    rng = random.Random(1)
    with_lang = make([(i, words(rng, lang, 40), lang) for i, lang in enumerate([*SOUNDS] * 10)])
    return language.train(with_lang.select("lang", "text"))


def test_languages_equal_plain_loops(model):
    rng = random.Random(2)
    texts = [words(rng, "aa", 12), words(rng, "bb", 9) + " " + words(rng, "cc", 6), " ".join(words(rng, lang, 8) for lang in SOUNDS), "torlin", words(rng, "cc", 1) + " " + words(rng, "aa", 1)]
    names, scores, _ = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        expected, share = plain_prediction(model, text)
        assert name == expected and score == pytest.approx(share, abs=1e-6)


def test_equal_languages_give_the_first_name(make):
    docs = make([(1, "torlin quas tor", "zz"), (2, "torlin quas tor", "bb"), (3, "mou chi era", "cc")])
    names, _, _ = language.train(docs.select("lang", "text")).predict(["quas torlin"])
    assert names == ["bb"]


def test_very_long_texts(spark, make, model):
    rng = random.Random(4)
    item, long = sentence(rng, 30), sentence(rng, 150_000)
    docs = make([(1, f"{long} {item} {long}"), (2, long), (3, words(rng, "bb", 100_000))])
    bench = spark.createDataFrame([(7, item), (8, sentence(rng, 20_000))], "item_id long, text string")
    with staging(spark):
        found = decontamination.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"], r["first_word"]) for r in found] == [(1, 7, 0, 150_000)]
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}[3] == "bb"
    url = "http://a.example.org/es/" + "x/" * 200_000
    pages = spark.createDataFrame([(1, url), (2, "http://" + "a." * 50_000 + "org/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.filter_urls(pages, URL_RULES).collect()} == {1: "example.org/es/", 2: "org/"}


def test_equally_good_places_give_the_first(spark, make):
    rng = random.Random(5)
    item = sentence(rng, 16)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    with staging(spark):
        found = decontamination.contaminated(make([(1, f"one two {item} three {item}")]), bench).collect()
    assert [(r["edits"], r["first_word"]) for r in found] == [(0, 2)]


def test_repeated_rows_through_the_pipeline(spark, make, folder, tmp_path):
    """Rows that repeat share their fate in every stage, and a copy under another id goes."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    text, other = "\n".join(sentence(rng, 12) for _ in range(6)), sentence(rng, 80)
    rows = [(1, text), (1, text), (2, text), (3, other), (3, other), (None, sentence(rng, 60)), (None, sentence(rng, 60))]
    rows.append(rows[-1])
    for name in ("documents", "benchmark"):
        (make(rows) if name == "documents" else spark.read.parquet(f"{folder}/benchmark.parquet")).write.parquet(f"{tmp_path}/{name}.parquet")
    packed = pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in packed:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + (r["start"] == 0)
    assert pieces == {1: 2, 3: 2, None: 3}
    assert np.unique([r["sequence_id"] for r in packed]).size >= 1
