import random

import numpy as np
import pytest

from synthtab.llm import decontamination, language, url_filter
from synthtab.llm.queries import URL_RULES

from .conftest import sentence

URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/en/1570?x#y", "http://a.b.example.org/es/", "http://example.org",
    "http://example.org/", "http://badexample.org/es/x", "ftp://x.com/fr/a", "http://x.com/FR/a", "http://x.com?/de/", "http://com/de/1",
    "http://x.com/de", "http://x.com/de/", "a://b://c.org/x", "http://x.org:80/a", "http://ÄX.com/fr/\n/b", "http://x.net/fr/", "http://example.org/en/2",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def check(spark, rules, rows, urls):
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")


def test_given_rules(spark, make):
    check(spark, URL_RULES, url_filter.filter_urls(pages(spark, URLS), URL_RULES).collect(), URLS)
    assert url_filter.filter_urls(pages(spark, []), URL_RULES).collect() == []


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_random_rules_by_trie_and_by_join(spark, make, most):
    rng = random.Random(3)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    paths = ["".join(rng.choice(["/", "x", "y"]) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(60)]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(paths)}" for _ in range(300)]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    check(spark, rules, url_filter.filter_urls(pages(spark, urls), table, most_bytes=most).collect(), urls)


def test_languages(spark, make):
    rng = random.Random(1)
    sounds = {"aa": ["tor", "lin", "quas"], "bb": ["éra", "mou", "chi"], "cc": ["zsc", "üng", "pf"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    docs = [(i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = language.train(make([*docs, (90, None, "aa"), (91, "x", None)]))
    assert model.languages == ["aa", "bb", "cc"]
    asked = [
        (100, text("aa", 30)), (101, text("bb", 30)), (102, None), (103, ""), (104, "12 3! "), (105, text("aa", 60) + " " + text("cc", 40)),
        (106, text("cc", 1)), (None, text("bb", 5)), (107, text("aa", 20_000)), (100, text("cc", 9)),
    ]
    rows = language.identify(make(asked), model).collect()
    found = {(r["doc_id"], r["lang_pred"]): r for r in rows}
    assert len(rows) == len(asked)
    assert {(100, "aa"), (100, "cc"), (101, "bb"), (102, "und"), (103, "und"), (104, "und"), (105, "aa"), (106, "cc"), (None, "bb"), (107, "aa")} == set(found)
    assert found[105, "aa"]["languages"] == ["aa", "cc"] and abs(found[105, "aa"]["score"] - 0.6) < 0.05
    assert found[101, "bb"]["languages"] == ["bb"] and all(0 <= r["score"] <= 1 for r in rows)
    kept = language.keep_documents(make(asked), model, 0.5).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(a[0]) for a in asked if a[0] not in (102, 103, 104))
    assert set(kept[0].asDict()) == set(make(asked).columns)
    assert language.identify(make([]), model).collect() == []


def test_the_score_is_the_share_within_the_chosen_set(make):
    """Close languages: the full mixture spreads the words of a text over all of them, the chosen set does not."""
    rng = random.Random(4)
    shared, own = ["tor", "lin", "quas", "mel", "dro", "pin"], {"aa": "va", "bb": "ke", "cc": "zu", "dd": "wo", "ee": "hy"}

    def text(lang, n):
        return " ".join("".join(rng.choice([*shared * 2, own[lang]]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    model = language.train(make([(i, text(lang, 40), lang) for i, lang in enumerate(list(own) * 20)]))
    asked = [(100 + i, text("aa", 60)) for i in range(10)]
    rows = language.identify(make(asked), model).collect()
    alone = {r["doc_id"] for r in rows if len(r["languages"]) == 1}
    assert alone and all(r["score"] == 1 for r in rows if r["doc_id"] in alone)
    assert alone <= {r["doc_id"] for r in language.keep_documents(make(asked), model, 0.5).collect()}


def test_nothing_learned(make):
    model = language.train(make([(1, "abc", None)]))
    assert [r["lang_pred"] for r in language.identify(make([(1, "abc")]), model).collect()] == ["und"]


def test_held_out_accuracy(spark, folder):
    from synthtab.llm.queries import op9_language

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op9_language(spark, folder).join(docs, "doc_id").where("held_out").collect()
    assert rows and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_closest_part():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(2))
        true = min(distance(a.tolist(), b[i:j].tolist()) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        found, begin = decontamination.closest(a, b)
        assert found == true
        assert true == min(distance(a.tolist(), b[begin:j].tolist()) for j in range(begin, len(b) + 1))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        place = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[place] = "changed"
        elif kind < 0.7:
            words.insert(place, "added")
        else:
            del words[place]
    return " ".join(words)


def test_planted_passages_reach_the_target_recall(spark, make):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.randint(14, 60))) for i in range(40)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "two words"), (None, "x"), (0, items[0][1])], "item_id long, text string")
    docs, planted = [], set()
    for d in range(400):
        text = sentence(rng, 120)
        if d % 2:
            i, t = rng.choice(items)
            n = len(t.split())
            text = f"{sentence(rng, rng.randint(0, 40))} {edited(rng, t.split(), rng.randint(0, n // 8)).upper()}!! {sentence(rng, rng.randint(0, 40))}"
            planted.add((d, i))
        docs.append((d, text))
    rows = decontamination.contaminated(make([*docs, (500, None), (501, ""), (None, items[3][1]), (502, items[3][1])]), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(planted & found) >= 0.98 * len(planted)
    assert {(None, 3), (502, 3)} <= found
    # Nothing else: every pair is confirmed exactly.
    assert not {d for d, _ in found if d is not None and d < 400 and d % 2 == 0}
    blocks = decontamination.contaminated(make(docs), bench, item_bytes=2000).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == {x for x in found if x[0] is not None and x[0] < 400}
    kept = {r["doc_id"] for r in decontamination.keep_clean(make(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_no_items_and_no_documents(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(make([(1, "a b c")]), none).collect() == []
    assert decontamination.keep_clean(make([(1, "a b c")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontamination.contaminated(make([]), some).collect() == []


def test_recall_against_every_window(spark, make):
    """Every item against every part of every text, by brute force: at least 95 % of the pairs within the bound, and no other."""
    rng = random.Random(17)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 4, 5, 6, 7, 8, 9, 12, 16, 20, 24, 32, 33, 40, 48, 64] * 2)]
    docs = []
    for d in range(120):
        text = sentence(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(items)[1].split()
            text += f" {edited(rng, words, rng.randint(0, len(words) // 8 + 1))} {sentence(rng, rng.randint(0, 30))}"
        docs.append((d, text))

    def hashes(texts):
        found, first = decontamination.words_of([t.encode() for t in texts])
        return np.split(found, first[1:])

    bodies, wanted = hashes([t for _, t in docs]), hashes([t for _, t in items])
    true = set()
    for d, body in enumerate(bodies):
        for i, item in enumerate(wanted):
            edits, _ = decontamination.closest(item, body) if len(body) else (len(item), 0)
            if edits <= len(item) // decontamination.WORDS_PER_EDIT:
                true.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(make(docs), bench).collect()}
    assert found <= true and len(found) >= 0.95 * len(true) > 50


def test_short_items_other_scripts_and_dashes(spark, make):
    items = [(1, "five words stand right here"), (2, "今日はとても天気がいいですね"), (3, "one two three four five six seven eight nine ten"), (4, "two words"), (5, None), (6, "«Que» pasa — hoy…"), (7, "")]
    docs = [
        (1, "so: FIVE words, stand right here!"), (2, "彼は「今日はとても天気がいいですね」と言った"), (3, "one—two three four five six “seven” eight nine ten"),
        (4, "two words"), (5, "five words stand left here"), (6, "¿que pasa hoy?"), (7, "今日は天気"), (8, "x two words five words stand right"), (9, "five words stand right here " * 3),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["edits"], r["first_word"]) for r in decontamination.contaminated(make(docs), bench).collect()}
    assert found == {(1, 1): (0, 1), (2, 2): (0, 2), (3, 3): (0, 0), (6, 6): (0, 0), (9, 1): (0, 0)}
    assert {r["doc_id"] for r in decontamination.keep_clean(make(docs), bench, item_bytes=10).collect()} == {4, 5, 7, 8}
    assert sorted((r["item_id"], r["n_words"]) for r in decontamination.skipped_items(bench).collect()) == [(4, 2), (5, 0), (7, 0)]
