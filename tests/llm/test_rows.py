import random

from synthtab.llm import decontamination, near_dup

from .conftest import sentence


def test_clean_rows_with_null_or_repeated_ids_stay(spark, make):
    rng = random.Random(21)
    item, clean = sentence(rng, 20), [sentence(rng, 30) for _ in range(4)]
    bench = spark.createDataFrame([(1, item), (2, sentence(rng, 25))], "item_id long, text string")
    rows = [(None, f"so {item} it goes"), (None, clean[0]), (-1, clean[1]), (5, f"{item} again"), (5, clean[2]), (6, None), (None, None), (7, "")]
    expected = sorted(map(str, [(None, clean[0]), (-1, clean[1]), (5, clean[2]), (6, None), (None, None), (7, "")]))
    for item_bytes in (decontamination.ITEM_BYTES, 10):
        kept = decontamination.keep_clean(make(rows), bench, item_bytes)
        assert kept.columns == make(rows).columns
        assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == expected


def test_unique_texts_stay_though_another_row_of_their_id_goes(make):
    rng = random.Random(22)
    text, own = sentence(rng, 80), sentence(rng, 80)
    rows = [(1, text), (2, text), (2, own), (None, text)]
    kept = near_dup.without_near_duplicates(make(rows)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(map(str, [(1, text), (2, own), (None, text)]))
