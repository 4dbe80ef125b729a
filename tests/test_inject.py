import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import synthtab as st


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), **columns}))


def nulls(pct, pattern="MCAR"):
    return {"null_patterns": {"x": {"null_pct": pct, "pattern": pattern}}}


def test_mcar_share(spark):
    out = st.inject_nulls(frame(spark, x=np.ones(5000)), nulls(50), "id", 1)
    assert 0.47 < out.toPandas().x.isna().mean() < 0.53


def test_unknown_pattern_is_mcar(spark):
    df = frame(spark, x=np.arange(200.0))
    assert st.inject_nulls(df, nulls(30, "WHY"), "id", 1).collect() == st.inject_nulls(df, nulls(30), "id", 1).collect()


def test_text_is_nulled_but_not_booleans(spark):
    df = frame(spark, x=["a", "b"] * 100, b=[True, False] * 100)
    profile = {"null_patterns": {c: {"null_pct": 50.0, "pattern": "MNAR"} for c in ("x", "b")}}
    out = st.inject_nulls(df, profile, "id", 1).toPandas()
    assert 60 < out.x.isna().sum() < 140 and out.b.notna().all()


def test_missing_columns_are_skipped(spark):
    df = frame(spark, x=[1.0, 2.0])
    profile = {s: {"other": {"null_pct": 50, "outlier_pct": 50, "rounding_pct": 50}} for s in ("null_patterns", "outlier_patterns", "noise_patterns")}
    assert st.apply_profile(df, profile, "id").collect() == df.collect()


def test_integers_become_doubles_even_at_zero_percent(spark):
    df = frame(spark, x=[1, 2, 3, 4, 5])
    assert dict(st.inject_nulls(df, nulls(0), "id").dtypes)["x"] == "double"
    assert st.inject_nulls(df, nulls(0), "id").toPandas().x.tolist() == [1, 2, 3, 4, 5]


def test_mar_follows_the_related_column(spark):
    n = 4000
    df = frame(spark, x=np.ones(n), r=np.arange(n, dtype=float))
    profile = {**nulls(40, "MAR"), "null_correlations": [{"cols": ["x", "r"], "jaccard": 0.5}]}
    out = st.inject_nulls(df, profile, "id", 2).toPandas()
    missing = out.x.isna()
    assert missing[n // 2 :].mean() > 0.5 > 0.3 > missing[: n // 2].mean()
    assert missing.mean() == pytest.approx(0.4, abs=0.03)


def test_mar_without_a_usable_partner_is_mcar(spark):
    df = frame(spark, x=np.ones(300))
    plain = st.inject_nulls(df, nulls(40), "id", 3).collect()
    for cols in (["x", "x"], ["x"], ["x", "gone"]):
        profile = {**nulls(40, "MAR"), "null_correlations": [{"cols": cols}]}
        assert st.inject_nulls(df, profile, "id", 3).collect() == plain


def test_mar_sees_earlier_changes(spark):
    """The related column is nulled first, so its median fills the gaps."""
    n = 2000
    df = frame(spark, r=np.arange(n, dtype=float), x=np.ones(n))
    profile = {
        "null_patterns": {"r": {"null_pct": 100.0, "pattern": "MCAR"}, "x": {"null_pct": 50.0, "pattern": "MAR"}},
        "null_correlations": [{"cols": ["x", "r"]}],
    }
    out = st.inject_nulls(df, profile, "id", 2).toPandas()
    assert out.r.isna().all() and out.x.notna().all()  # nothing to depend on


def test_mnar_prefers_extremes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 5000)
    out = st.inject_nulls(frame(spark, x=x), nulls(30, "MNAR"), "id", 4).toPandas().sort_values("id")
    missing = out.x.isna().to_numpy()
    assert np.abs(x[missing]).mean() > 1.3 * np.abs(x[~missing]).mean()


def test_all_null_columns_survive(spark):
    df = frame(spark, y=np.ones(50)).withColumn("x", F.lit(None).cast("double"))
    profile = {
        **nulls(50, "MNAR"),
        "outlier_patterns": {"x": {"outlier_pct": 10}},
        "noise_patterns": {"x": {"rounding_pct": 50, "precision": 1.0}},
    }
    assert st.apply_profile(df, profile, "id").toPandas().x.isna().all()


@pytest.mark.parametrize("direction, low, high", [("high", 0, 20), ("low", 20, 0), ("sideways", 20, 0)])
def test_outlier_count_and_side(spark, direction, low, high):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 1000)
    profile = {"outlier_patterns": {"x": {"direction": direction, "outlier_pct": 2.0}}}
    out = st.inject_outliers(frame(spark, x=x), profile, "id", 5).toPandas().x
    q1, q3 = np.percentile(x, [25, 75])
    assert ((out < q1 - 2.9 * (q3 - q1)).sum(), (out > q3 + 2.9 * (q3 - q1)).sum()) == (low, high)


def test_outliers_of_a_constant_column_keep_its_value(spark):
    profile = {"outlier_patterns": {"x": {"direction": "both", "outlier_pct": 20.0}}}
    out = st.inject_outliers(frame(spark, x=[5.0] * 10), profile, "id")
    assert out.toPandas().x.tolist() == [5.0] * 10


def test_at_least_one_outlier_and_too_few_values(spark):
    profile = {"outlier_patterns": {"x": {"direction": "high", "outlier_pct": 0.01}}}
    df = frame(spark, x=np.arange(20.0))
    assert (st.inject_outliers(df, profile, "id").toPandas().x > 20).sum() == 1
    few = frame(spark, x=[1.0, 2.0, 3.0, 4.0])
    assert st.inject_outliers(few, profile, "id").collect() == few.collect()


def test_outliers_may_overwrite_nulls(spark):
    df = frame(spark, x=np.arange(100.0)).withColumn("x", F.when(F.col("id") < 50, F.col("x")))
    profile = {"outlier_patterns": {"x": {"direction": "high", "outlier_pct": 100.0}}}
    assert st.inject_outliers(df, profile, "id").toPandas().x.notna().all()


@pytest.mark.parametrize("step", [1.0, 0.25])
def test_rounding_noise(spark, step):
    x = np.random.default_rng(2).normal(10, 3, 1000)
    profile = {"noise_patterns": {"x": {"rounding_pct": 60.0, "precision": step}}}
    out = st.inject_noise(frame(spark, x=x), profile, "id").toPandas().x
    assert ((out / step) % 1 == 0).sum() == 600


def test_rounding_counts_present_values_only(spark):
    df = frame(spark, x=np.arange(100) + 0.3).withColumn("x", F.when(F.col("id") < 40, F.col("x")))
    profile = {"noise_patterns": {"x": {"rounding_pct": 50.0, "precision": 1.0}}}
    out = st.inject_noise(df, profile, "id").toPandas().x
    assert (out % 1 == 0).sum() == 20 and out.isna().sum() == 60


def test_zero_percent_changes_nothing(spark):
    df = frame(spark, x=np.arange(30) + 0.5)
    for rounding in ({"rounding_pct": 0.0, "precision": 1.0}, {"precision": 1.0}, {"rounding_pct": 50.0, "precision": 0}):
        assert st.inject_noise(df, {"noise_patterns": {"x": rounding}}, "id").collect() == df.collect()


def test_stages_can_be_switched_off(spark):
    df = frame(spark, x=np.arange(100.0))
    profile = {**nulls(50), "outlier_patterns": {"x": {"direction": "high", "outlier_pct": 10.0}}}
    kept = st.apply_profile(df, profile, "id", nulls=False, outliers=False)
    assert kept.collect() == df.collect()
    only = st.apply_profile(df, profile, "id", nulls=False).toPandas()
    assert only.x.isna().sum() == 0 and (only.x > 99).sum() == 10


def test_results_do_not_depend_on_partitions(spark):
    df = frame(spark, x=np.random.default_rng(3).normal(0, 1, 2000))
    profile = {
        **nulls(20, "MNAR"),
        "outlier_patterns": {"x": {"outlier_pct": 3.0}},
        "noise_patterns": {"x": {"rounding_pct": 40.0, "precision": 0.5}},
    }
    a = st.apply_profile(df.repartition(3), profile, "id", 8).orderBy("id").collect()
    b = st.apply_profile(df.repartition(11), profile, "id", 8).orderBy("id").collect()
    assert a == b


def test_key_columns_are_protected(spark):
    with pytest.raises(ValueError, match="key"):
        st.inject_nulls(frame(spark, x=[1.0]), nulls(50), "x")


def test_apply_skew_keeps_nulls(spark):
    df = frame(spark, x=np.random.default_rng(4).normal(50, 5, 3000)).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("x")))
    out = st.apply_skew(df, {"skew_profiles": {"x": {"distribution_hint": "powerlaw", "skewness": 3.0}}}, "id").toPandas()
    assert out.x.isna().sum() == 1000 and out.x.skew() > 1


def test_injection_adds_no_shuffle_and_no_python(spark):
    df = frame(spark, x=np.arange(100.0))
    profile = {**nulls(20, "MNAR"), "outlier_patterns": {"x": {"outlier_pct": 3.0}}}
    plan = st.apply_profile(df, profile, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
