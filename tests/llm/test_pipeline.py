import random

import pytest

from .conftest import sentence


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_of_given_documents(spark, folder, pipeline):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        path = f"{pipeline.fresh_path(spark, 'test-stage')}"
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()
    ran = pipeline.run(spark, folder)
    assert ran.columns == packed.columns and ran.count() == packed.count()


def test_decisions(spark, folder, make, pipeline):
    rng = random.Random(3)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    near = sentence(rng, 100)
    rows = [
        (1, None), (2, "123 456"), (3, sentence(rng, 50)), (4, near), (5, near + " one more"), (6, sentence(rng, 20) + "\n" + item + "\n" + sentence(rng, 20)),
        (7, sentence(rng, 10)),
    ]
    stages = dict(pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stages["language"](spark, make(rows), folder)) == [3, 4, 5, 6, 7]
    assert ids(stages["near_duplicates"](spark, make(rows), folder)) == [1, 2, 3, 4, 6, 7]
    assert ids(stages["decontamination"](spark, make(rows), folder)) == [1, 2, 3, 4, 5, 7]
    assert set(r["doc_id"] for r in stages["packing"](spark, make(rows), folder).collect()) == {1, 2, 3, 4, 5, 6, 7}
    for name, stage in pipeline.STAGES:
        assert stage(spark, make([]), folder).collect() == [], name


def test_unlabelled_documents_stay(spark, folder, make, pipeline):
    rows = [(1, "some words", None), (2, "12", None), (3, None, None)]
    assert [r["doc_id"] for r in pipeline.language_stage(spark, make(rows), folder).collect()] == [1]
