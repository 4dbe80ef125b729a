import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import synthtab as st
from synthtab.operators import quality
from synthtab.plans.dataset import adjust_profile, adjust_schema
from synthtab.plans.spec import ColumnSpec

SCHEMA = [
    ColumnSpec("id", "text"),
    ColumnSpec("price", "numeric", "normal", mean=50.0, std=10.0, min=0.0, max=100.0),
    ColumnSpec("qty", "integer", mean=5.0, std=2.0, min=1.0, max=10.0),
]


def test_own_output_scores_well(spark):
    score = st.score_batch(st.generate(spark, SCHEMA, 5000, 1), SCHEMA)
    assert score["ks_count"] == 2 and score["quality_score"] >= 0.8
    assert {"ks_price", "ks_qty", "null_drift_id", "corr_diff", "ks_mean", "ks_max"} <= set(score)


def test_wrong_distribution_scores_badly(spark):
    off = [SCHEMA[0], SCHEMA[1].with_(mean=90.0), SCHEMA[2]]
    score = st.score_batch(st.generate(spark, off, 2000, 1), SCHEMA)
    assert score["ks_price"] > 0.8 and score["quality_score"] < 0.7


def test_text_only_and_empty(spark):
    texts = [ColumnSpec("a"), ColumnSpec("b")]
    assert st.score_batch(st.generate(spark, texts, 50), texts)["quality_score"] == 1.0
    empty = spark.createDataFrame([], "price double")
    score = st.score_batch(empty, SCHEMA)
    assert score["ks_count"] == 0 and score["quality_score"] == 1.0


def test_absent_columns_are_skipped(spark):
    df = st.generate(spark, SCHEMA, 500, 1).select("price")
    score = st.score_batch(df, SCHEMA)
    assert "ks_qty" not in score and "corr_diff" not in score


def test_few_values_have_no_ks(spark):
    df = st.generate(spark, SCHEMA, 9, 1)
    assert st.score_batch(df, SCHEMA)["ks_count"] == 0


def test_drift_and_correlation_equal_pandas(spark):
    pdf = st.generate(spark, SCHEMA, 800, 3).toPandas()
    pdf.loc[::5, "price"] = np.nan
    df = spark.createDataFrame(pdf)
    assert quality.null_drift(df, SCHEMA)["price"] == 0.2
    ref = st.reference_sample(spark, SCHEMA).toPandas()
    expected = (pdf[["price", "qty"]].corr("spearman") - ref[["price", "qty"]].corr("spearman")).abs().to_numpy().mean()
    assert quality.correlation_difference(df, SCHEMA) == pytest.approx(round(expected, 4))


def test_constant_column_gives_no_correlation_penalty(spark):
    df = spark.createDataFrame(pd.DataFrame({"price": np.full(50, 3.0), "qty": np.arange(50)}))
    assert quality.correlation_difference(df, SCHEMA) is None


def test_composite_score():
    assert quality.composite_score({"ks_mean": 0.1, "null_drift_mean": 0.0}) == 0.7
    assert quality.composite_score({"ks_mean": 0.1, "null_drift_mean": 0.05, "corr_diff": 1.0}) == 0.4


def test_reference_sample_has_no_skew_inference(spark):
    specs = quality.reference_specs([ColumnSpec("a", "numeric", skewness=3.0), ColumnSpec("t")])
    assert [(s.name, s.distribution_hint) for s in specs] == [("a", "normal")]
    assert st.reference_sample(spark, SCHEMA).count() == 10_000


def test_adjust_schema():
    specs = [ColumnSpec("a", "numeric", mean=50.0, null_ratio=0.2), ColumnSpec("b", "numeric"), ColumnSpec("c", "numeric", mean=0.0)]
    out = adjust_schema(specs, {"ks_a": 0.2, "null_drift_a": 0.05, "ks_b": 0.05, "ks_c": 0.5})
    assert (out[0].mean, out[0].null_ratio) == (49.0, 0.15)
    assert out[1] == specs[1]
    assert out[2].mean == 47.5  # a mean of 0 counts as missing, so 50
    assert specs[0].mean == 50.0


def test_adjust_profile():
    profile = {"null_patterns": {"a": {"null_pct": 10.0, "pattern": "MAR"}, "b": {"null_pct": 0.0}}}
    quality_ = {"null_drift_a": 0.1, "null_drift_b": 0.5}
    out = adjust_profile(profile, quality_, [ColumnSpec("a"), ColumnSpec("b")])
    assert out["null_patterns"] == {"a": {"null_pct": 9.5, "pattern": "MAR"}, "b": {"null_pct": 0.0}}
    assert profile["null_patterns"]["a"]["null_pct"] == 10.0
    assert adjust_profile(None, quality_, []) is None


def test_generate_dataset(spark):
    df = st.generate_dataset(spark, "e-commerce", 400, seed=3)
    pdf = df.toPandas()
    assert len(pdf) == 400 and df.columns == [s.name for s in st.generic_schema("e-commerce")]
    assert 0 < pdf.shipping_address.isna().sum() < 200
    assert df.toPandas().equals(pdf)
    clean = st.generate_dataset(spark, "e-commerce", 50, imperfections=False, seed=3).toPandas()
    assert clean.notna().all().all()
    assert st.generate_dataset(spark, "e-commerce", 5).count() == 5
    with pytest.raises(RuntimeError, match="no dataset could be made"):
        st.generate_dataset(spark, "x", 5, specs=[ColumnSpec("d", "datetime", min_date="never")])


@pytest.mark.parametrize("total, batch", [(50, 100), (250, 100), (300, 100)])
def test_batch_sizes(spark, total, batch):
    made = st.batched_generate(spark, "custom", total, batch, SCHEMA, seed=1, retries=0)
    assert made.data.count() == total
    assert len({e["batch"] for e in made.log}) == -(-total // batch)
    assert made.log_frame().filter("metric = 'quality_score'").count() == len(made.log)


def test_batches_repeat_with_the_seed(spark):
    def rows(seed):
        made = st.batched_generate(spark, "custom", 120, 60, SCHEMA, seed=seed, retries=0)
        return made.data.collect()

    assert rows(4) == rows(4) != rows(5)


def test_retries_keep_the_last_attempt(spark):
    made = st.batched_generate(spark, "custom", 60, 60, SCHEMA, seed=4, threshold=2.0, retries=2)
    assert [e["attempt"] for e in made.log] == [0, 1, 2]
    assert made.data.count() == 60


def test_numbers_go_on_across_batches(spark):
    specs = [ColumnSpec("note")]
    made = st.batched_generate(spark, "custom", 6, 3, specs, False, seed=1)
    assert sorted(r[0] for r in made.data.collect()) == [f"Note {i}" for i in range(1, 7)]
    again = st.batched_generate(spark, "custom", 6, 3, specs, False, seed=1, continue_numbers=False)
    assert sorted(r[0] for r in again.data.collect()) == sorted([f"Note {i}" for i in range(1, 4)] * 2)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_batches_scored_together_equal_batches_scored_alone(spark):
    from functools import reduce

    from pyspark.sql import DataFrame

    parts = [st.generate(spark, SCHEMA, n, s) for n, s in ((300, 1), (40, 2), (5, 3), (200, 4))]
    parts = [p.withColumn(p.columns[0], F.when(F.lit(i) != 3, F.col(p.columns[0]))) for i, p in enumerate(parts)]
    wave = reduce(DataFrame.unionByName, [p.withColumn("b", F.lit(i * 3)) for i, p in enumerate(parts)])
    found = quality.score_batches(wave, SCHEMA, "b")
    assert found == {i * 3: quality.score_batch(p, SCHEMA) for i, p in enumerate(parts)}


def test_jobs_of_a_wave_do_not_grow_with_its_batches(spark):
    def made(n):
        return st.batched_generate(spark, "e-commerce", n * 50, 50, seed=3, retries=1, threshold=2.0, wave=n)

    (two, few), (seven, many) = (jobs_of(spark, f"wave {n}", lambda n=n: made(n)) for n in (2, 7))
    assert many <= few + 3 and len(two.log) == 4 and len(seven.log) == 14
    assert seven.data.count() == 350 and [e["attempt"] for e in seven.log] == [0, 1] * 7


def test_waves_retry_single_batches_and_pass_feedback_on(spark):
    """Only poor batches are made again; what the first wave measured changes the second."""
    specs = [ColumnSpec("x", "numeric", "normal", mean=40.0, std=5.0, null_ratio=0.5)]
    made = st.batched_generate(spark, "custom", 240, 60, specs, False, threshold=0.95, retries=2, seed=8, wave=2)
    tries = {b: [e["attempt"] for e in made.log if e["batch"] == b] for b in range(4)}
    assert all(t == list(range(len(t))) for t in tries.values()) and made.data.count() == 240
    drift = {b: [e["null_drift_x"] for e in made.log if e["batch"] == b][-1] for b in range(4)}
    # 0.5 less once the drift for each of two batches: the ratio is 0 from the second wave on.
    assert drift == {0: 0.5, 1: 0.5, 2: 0.0, 3: 0.0}
    alone = st.batched_generate(spark, "custom", 240, 60, specs, False, threshold=0.95, retries=2, seed=8)
    assert [e["null_drift_x"] for e in alone.log if e["batch"] == 1][-1] == 0.0
