import json

import numpy as np
import pandas as pd
import pytest

import synthtab as st
from synthtab.operators import profile as module
from synthtab.operators.profile import Profiler


def small_missing(seed=42, n=500):
    """MCAR at random, MAR by another column, MNAR by its own tail."""
    rng = np.random.default_rng(seed)
    related, mnar = rng.uniform(0, 1, n), rng.lognormal(0, 1, n)
    return pd.DataFrame(
        {
            "always_present": np.arange(n),
            "mcar_col": np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 1, n)),
            "mar_col": np.where(related > 0.7, np.nan, rng.normal(0, 1, n)),
            "related_col": related,
            "mnar_col": np.where(mnar > np.quantile(mnar, 0.9), np.nan, mnar),
        }
    )


def null_pairs_brute_force(pdf):
    mask, out = pdf.isna(), []
    for i, a in enumerate(pdf.columns):
        for b in pdf.columns[i + 1 :]:
            both, either = (mask[a] & mask[b]).sum(), (mask[a] | mask[b]).sum()
            if either:
                out.append((a, b, both / len(pdf), both / either))
    return sorted(out, key=lambda r: -r[2])


@pytest.mark.parametrize("limit", [300, 0])
def test_null_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(module, "MANY_PAIRS", limit)  # 0 takes the way for wide tables
    pdf = small_missing()
    found = Profiler(spark.createDataFrame(pdf)).null_pairs()
    expected = null_pairs_brute_force(pdf)
    assert [(p["col_i"], p["col_j"]) for p in found] == [(a, b) for a, b, *_ in expected]
    for p, (_, _, ratio, jaccard) in zip(found, expected):
        assert p["co_null_ratio"] == pytest.approx(ratio) and p["jaccard"] == pytest.approx(jaccard)


def test_null_pairs_top_k(spark):
    df = spark.createDataFrame(small_missing())
    assert st.null_pairs(df, 2).count() == 2
    assert st.null_pairs(df.select("always_present")).count() == 0


def test_outliers_equal_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"v": rng.standard_t(2, 800), "w": rng.uniform(0, 1, 800), "b": rng.random(800) > 0.5})
    pdf.loc[::7, "v"] = np.nan
    found = Profiler(spark.createDataFrame(pdf)).outliers()
    assert set(found) == {"v"}
    v = pdf.v.dropna()
    q1, q3 = np.percentile(v, [25, 75])
    out = v[(v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))]
    assert found["v"]["outlier_pct"] == pytest.approx(100 * len(out) / len(v))
    assert found["v"]["outlier_mean"] == pytest.approx(out.mean())
    assert found["v"]["outlier_std"] == pytest.approx(out.std())
    assert found["v"]["above_upper_pct"] == pytest.approx(100 * (out > q3).mean())
    assert found["v"]["direction"] == "both"
    assert "weekend_concentration" not in found["v"]


def test_weekend_column_is_found_by_name(spark):
    days = pd.date_range("2024-01-01", periods=70)  # a Monday
    value = np.where(days.dayofweek == 5, 100.0, 1.0 + np.arange(70) % 3)
    text = spark.createDataFrame(pd.DataFrame({"some_date": days.astype(str), "v": value}))
    assert Profiler(text).outliers()["v"]["weekend_concentration"] == 1.0
    broken = spark.createDataFrame(pd.DataFrame({"lifetime": ["soon"] * 70, "v": value}))
    assert Profiler(broken).outliers()["v"]["weekend_concentration"] == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_moments_equal_pandas(spark, seed):
    pdf = pd.DataFrame({"v": np.random.default_rng(seed).lognormal(0, seed / 3 + 0.2, 400)})
    info = Profiler(spark.createDataFrame(pdf)).skew_hints()["v"]
    assert info["skewness"] == pytest.approx(pdf.v.skew())
    assert info["kurtosis"] == pytest.approx(pdf.v.kurtosis())


@pytest.mark.parametrize(
    "skew, kurtosis, hint",
    [(0.1, 0.2, "normal"), (0.1, 0.6, "uniform"), (1.1, 0, "powerlaw"), (0.7, 0, "lognormal"), (-0.7, 0, "neg_binomial"), (0.4, 0, "uniform")],
)
def test_shape_hint(skew, kurtosis, hint):
    assert module.shape_hint(skew, kurtosis) == hint


def test_constant_column_is_normal(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [4.0] * 30}))
    assert Profiler(df).skew_hints()["v"] == {"distribution_hint": "normal", "skewness": 0.0, "kurtosis": 0.0}
    assert Profiler(df).noise()["v"] == {"rounding_pct": 100.0, "precision": 0.0}


def test_missingness_classes(spark):
    found = Profiler(spark.createDataFrame(small_missing())).missingness()
    columns = found["columns"]
    assert set(columns) == {"mcar_col", "mar_col", "mnar_col"}
    assert columns["mar_col"]["pattern"] in ("MAR", "MNAR")
    assert "related_col_mnar_hint" in columns["mar_col"]["correlated_with"]
    assert columns["mcar_col"]["null_pct"] == pytest.approx(100 * small_missing().mcar_col.isna().mean())
    clean = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0]}))
    assert Profiler(clean).missingness() == {"columns": {}, "global_summary": "no_missing"}


def test_links_equal_pandas(spark):
    rng = np.random.default_rng(7)
    a = rng.random(300) < 0.3
    pdf = pd.DataFrame({"a": np.where(a, np.nan, 1.0), "b": np.where(a | (rng.random(300) < 0.1), None, "x"), "c": [None] * 300})
    df = spark.createDataFrame(pdf, "a double, b string, c string")
    links = Profiler(df).null_links()
    expected = round(pdf.a.isna().corr(pdf.b.isna()), 3)
    assert links == {("a", "b"): expected, ("b", "a"): expected}  # an all-null column has no correlation


def test_noise_needs_twenty_values(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": np.arange(19.0), "i": np.arange(19)}))
    assert st.noise(df).count() == 0


def test_rounding_share(spark):
    v = [1.0, 1.5, 1.99, 2.25] * 10
    df = spark.createDataFrame(pd.DataFrame({"v": v, "i": np.arange(40)}))
    found = Profiler(df).noise()
    assert found["v"]["rounding_pct"] == 75.0
    assert found["i"] == {"rounding_pct": 0.0, "precision": 1.0}


def test_fingerprint_is_json_and_tidy(spark):
    df = spark.createDataFrame(small_missing())
    print_ = st.fingerprint(df, "d", "s")
    data = json.loads(print_.to_json())
    assert (data["domain"], data["dataset"], data["row_count"], data["column_count"]) == ("d", "s", 500, 5)
    assert set(data) >= {"null_correlations", "outliers", "skew_profiles", "missingness", "noise"}
    facts = st.fingerprint_frame(df).toPandas()
    assert set(facts.section) == {"table", "null_pair", "outlier", "skew", "missing", "noise"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    found = st.fingerprint(df)
    assert (found.row_count, found.outliers, found.noise) == (0, {}, {})
    assert st.table_summary(df).first()["null_pct"] is None


def test_reports_equal_pandas(spark):
    pdf = small_missing()
    df = spark.createDataFrame(pdf)
    summary = st.table_summary(df).first()
    share = round(pdf.isna().sum().sum() / pdf.size * 100, 1)
    assert (summary["rows"], summary["columns"], summary["null_pct"]) == (500, 5, share)
    worst = st.worst_nulls(df).collect()
    expected = pdf.isna().sum().loc[lambda s: s > 0].sort_values(ascending=False)
    assert [r["nulls"] for r in worst] == list(expected)
    stats = st.column_statistics(df).toPandas().set_index("column_name")
    described = pdf.describe().round(2)
    for c in pdf.columns:
        for mine, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("max", "max")):
            assert stats.loc[c, mine] == pytest.approx(described.loc[theirs, c], abs=0.0101)


def test_column_statistics_of_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    row = st.column_statistics(df).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (4, 2, "a", 2)


@pytest.mark.parametrize("approx", [False, True])
def test_profile_columns(spark, approx):
    df = spark.createDataFrame([(i, float(i % 7), "x", None) for i in range(50)], "i int, d double, s string, n string")
    rows = {r["column_name"]: r for r in st.profile_columns(df, approx).collect()}
    assert rows["d"]["distinct_count"] == 7 and rows["s"]["distinct_count"] == 1
    assert rows["n"]["null_ratio"] == 1.0 and rows["n"]["distinct_count"] == 0
    assert json.loads(rows["i"]["sample_values"]) == ["0", "1", "2", "3", "4"]
    assert json.loads(rows["n"]["sample_values"]) == []
    assert rows["d"]["std"] == pytest.approx(np.std([i % 7 for i in range(50)], ddof=1))


def test_scan_reads_only_the_needed_columns(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_totalprice")
    plan = st.outlier_counts(orders)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double>" in plan
