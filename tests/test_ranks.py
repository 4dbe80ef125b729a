import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthtab.functions.literals import double_array, search_sorted
from synthtab.functions.rng import Draw, row_key
from synthtab.operators import ranks
from synthtab.operators.profile import Profiler


@pytest.fixture
def small_cells(monkeypatch):
    """Many cells although the tables are small."""
    monkeypatch.setattr(ranks, "ROWS_PER_CELL", 150)


def messy(spark, n=3000, seed=3):
    """Hot values, nulls, ties, heavy tails, one constant column."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 5, n).round(1)),
            "tail": rng.pareto(0.6, n) * 10.0 ** rng.integers(-12, 12, n),
            "ties": rng.integers(0, 9, n).astype(float),
            "same": np.full(n, 3.5),
        }
    )
    pdf.loc[rng.random(n) < 0.3, "hot"] = np.nan
    pdf.loc[(pdf.ties > 6) & (rng.random(n) < 0.8), "tail"] = np.nan
    return pdf, spark.createDataFrame(pdf)


COLUMNS = ["hot", "tail", "ties", "same"]


def columns(names=COLUMNS):
    return {c: ranks.clean_double(F.col(c)) for c in names}


@pytest.mark.parametrize("probabilities", [[0.25, 0.75], [0.0, 0.001, 0.5, 0.999, 1.0]])
def test_quantiles_equal_numpy(spark, probabilities):
    pdf, df = messy(spark)
    found = ranks.quantiles(df, columns(), probabilities)
    for c in COLUMNS:
        expected = np.quantile(pdf[c].dropna(), probabilities)
        assert found[c] == pytest.approx(list(expected), rel=1e-13)


def test_quantiles_of_tiny_and_extreme_columns(spark):
    values = [1.7e308, -1.7e308, 5e-324, 0.0, None, 1e-300]
    df = spark.createDataFrame([(v, None) for v in values], "a double, b double")
    found = ranks.quantiles(df, columns(["a", "b"]), [0.5, 0.25])
    assert found["a"][0] == 5e-324
    assert found["b"] is None
    one = df.filter("a = 0")
    assert ranks.quantiles(one, columns(["a"]), [0.25])["a"] == [0.0]


def test_quantiles_with_infinite_ends(spark):
    values = [float("-inf"), 1.0, 2.0, 4.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    found = ranks.quantiles(df, columns(["a"]), [0.0, 0.4, 0.5, 1.0])
    assert found["a"] == [float("-inf"), 2.0, 3.0, float("inf")]


def test_exact_k_is_the_k_smallest_draws(spark):
    df = spark.range(5000)
    key = row_key(df, "id")
    draw = Draw(key, 4, "t").u1
    for k in (1, 17, 2500, 4999, 5000):
        chosen = ranks.exact_k(df, {"a": ranks.Choice(draw, k, 5000)}, key)["a"]
        got = {r[0] for r in df.filter(chosen).collect()}
        expected = {r[0] for r in df.orderBy(draw).limit(k).collect()}
        assert got == expected


def test_exact_k_breaks_ties_by_key(spark):
    df = spark.range(1000)
    draw = (F.col("id") % 10 + F.lit(0.5)) / F.lit(10.0)
    key = F.format_string("%05d", F.col("id"))
    chosen = ranks.exact_k(df, {"a": ranks.Choice(draw, 250, 1000)}, key)["a"]
    got = sorted(r[0] for r in df.filter(chosen).collect())
    assert len(got) == 250
    assert [i for i in got if i % 10 == 2] == [2 + 10 * i for i in range(50)]


def test_exact_k_with_one_draw_for_all_rows(spark):
    """Any number of ties: the key decides, and a key that repeats is refused."""
    df = spark.range(5000)
    key = F.format_string("é%05d", F.col("id"))
    for k in (1, 1234, 4999):
        chosen = ranks.exact_k(df, {"a": ranks.Choice(F.lit(0.25), k, 5000)}, key)["a"]
        assert sorted(r[0] for r in df.filter(chosen).collect()) == list(range(k))
    for part, k in ((F.col("id") % 7, 700), (F.when(F.col("id") < 4000, F.col("id")).otherwise(F.lit(7777)), 4500)):
        with pytest.raises(ValueError, match="not unique"):
            ranks.exact_k(df, {"a": ranks.Choice(F.lit(0.25), k, 5000)}, part.cast("string"))


def test_exact_k_refuses_repeated_keys(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"))
    key = row_key(df, "k")
    with pytest.raises(ValueError, match="not unique"):
        ranks.exact_k(df, {"a": ranks.Choice(Draw(key, 1, "t").u1, 30, 100)}, key)


@pytest.mark.parametrize("side", ["left", "right"])
def test_search_sorted(spark, side):
    edges = [-2.0, 0.0, 0.5, 3.0, 3.5, 9.0, 11.0]
    values = [-3.0, -2.0, -1.0, 0.0, 0.4, 0.5, 3.0, 3.2, 9.0, 10.0, 11.0, 12.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = search_sorted(df, double_array(edges), len(edges), "v", "i", side)
    assert [r["i"] for r in found.collect()] == list(np.searchsorted(edges, values, side=side))


@pytest.mark.parametrize("cells", ["one", "many"])
def test_spearman_equals_pandas(spark, cells, request):
    if cells == "many":
        request.getfixturevalue("small_cells")
    pdf, df = messy(spark)
    expected = pdf[COLUMNS].corr(method="spearman")
    for (a, b), rho in ranks.spearman(df, columns()).items():
        if "same" in (a, b):
            assert rho is None
        else:
            assert rho == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_spearman_deals_the_table_out_twice(spark):
    """As many shuffles for nine columns as for two, and no expression for each pair."""
    pdf, df = messy(spark)
    wide = {f"{c}{i}": ranks.clean_double(F.col(c) * (i + 1)) for c in COLUMNS[:3] for i in range(3)}

    def plan(names):
        some = {n: wide[n] for n in names}
        return ranks._ranked_rows(df, some, [None], len(pdf))._jdf.queryExecution().optimizedPlan().toString()

    two, nine = plan(list(wide)[:2]), plan(list(wide))
    assert two.count("Join") == nine.count("Join") and two.count("Aggregate") == nine.count("Aggregate")
    found = ranks.spearman(df, wide)
    expected = pd.DataFrame({n: pdf[n[:-1]] for n in wide}).corr(method="spearman")
    assert all(rho == pytest.approx(expected.loc[a, b], abs=1e-12) for (a, b), rho in found.items()) and len(found) == 36


def ks_brute_force(a, b):
    a, b = np.sort(a), np.sort(b)
    points = np.concatenate([a, b])
    left = np.searchsorted(a, points, side="right") / len(a)
    return np.abs(left - np.searchsorted(b, points, side="right") / len(b)).max()


def test_ks_against_samples_equals_brute_force(spark):
    pdf, df = messy(spark)
    rng = np.random.default_rng(1)
    samples = {"hot": rng.normal(0, 5, 700).round(1), "tail": rng.pareto(1, 900), "same": np.full(200, 3.5)}
    found = ranks.ks_against_samples(df, columns(), samples)
    for c, sample in samples.items():
        data = pdf[c].dropna().to_numpy()
        assert found[c] == (pytest.approx(ks_brute_force(data, sample), abs=1e-12), len(data))


@pytest.mark.parametrize("cells", ["one", "many"])
def test_gaps_and_shifts_equal_brute_force(spark, cells, request):
    if cells == "many":
        request.getfixturevalue("small_cells")
    pdf, df = messy(spark)
    profiler = Profiler(df.drop("id"))
    noise, shifts = profiler.noise(), profiler.value_shifts()
    for c in COLUMNS:
        unique = np.sort(pdf[c].dropna().unique())
        assert noise[c]["precision"] == (np.diff(unique).min() if len(unique) > 1 else 0.0)
    assert set(shifts) == {(m, o) for m in ("hot", "tail") for o in COLUMNS if o != m}
    for (m, o), (d, n1, n2, _) in shifts.items():
        present, missing = pdf[pdf[m].notna()][o].dropna(), pdf[pdf[m].isna()][o].dropna()
        assert (n1, n2) == (len(present), len(missing))
        assert d == pytest.approx(ks_brute_force(present, missing), abs=1e-12)


def test_kolmogorov_p_values():
    # critical values of the limiting distribution
    assert ranks.kolmogorov_p(1.3581015 / np.sqrt(500), 1000, 1000) == pytest.approx(0.05, abs=1e-4)
    assert ranks.kolmogorov_p(1.6276 / np.sqrt(500), 1000, 1000) == pytest.approx(0.01, abs=1e-4)
    assert ranks.kolmogorov_p(0.0, 10, 10) == 1.0
    assert ranks.kolmogorov_p(1.0, 10_000, 10_000) == 0.0


@pytest.mark.parametrize("kind", ["uniform", "tails", "point", "cluster", "infinite"])
def test_quantiles_take_few_passes_on_any_data(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    n = 20_000
    values = {
        "uniform": rng.random(n),
        "tails": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n),
        "point": np.where(rng.random(n) < 0.6, 1.5, 10.0 ** rng.uniform(-300, 300, n)),
        "cluster": np.where(rng.random(n) < 0.5, 1e300 * rng.random(n), 7 + 1e-9 * rng.random(n)),
        "infinite": np.where(rng.random(n) < 0.1, np.inf, rng.normal(size=n)),
    }[kind]
    passes = []
    real = ranks._histograms
    monkeypatch.setattr(ranks, "_histograms", lambda *a: passes.append(1) or real(*a))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = ranks.quantiles(df, {"x": F.col("x")}, [0.1, 0.25, 0.5, 0.75])["x"]
    assert len(passes) <= 4
    ordered = np.sort(values)
    for p, q in zip([0.1, 0.25, 0.5, 0.75], found):
        place = (n - 1) * p
        a, b = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        assert a <= q <= b


def test_the_plan_of_ks_does_not_hold_the_sample(spark, monkeypatch):
    seen = []
    _, df = messy(spark, 300)
    kind = type(df)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow, **b: seen.append(f(self, *a, **b)) or seen[-1])
    rng = np.random.default_rng(2)
    for n in (200, 10_000):
        ranks.ks_against_samples(df, columns(["hot", "tail"]), {"hot": rng.normal(0, 5, n), "tail": rng.pareto(1, n)})
    small, large = (len(x._jdf.queryExecution().optimizedPlan().toString()) for x in seen[-2:])
    assert abs(small - large) < 200


@pytest.mark.parametrize("limit", [0, 100, 10**6])
def test_spearman_with_columns_of_few_values(spark, limit, monkeypatch):
    """The same with none, some or all columns looked up in tasks; only the others are dealt out."""
    pdf, df = messy(spark)
    names = [*COLUMNS, "small"]
    pdf = pdf.assign(small=np.where(np.arange(len(pdf)) % 7 == 0, np.nan, np.arange(len(pdf)) % 5))
    df = spark.createDataFrame(pdf[names].astype(float))
    monkeypatch.setattr(ranks, "FEW_NUMBERS", limit)
    dealt = []
    rows_of = ranks._ranked_rows
    monkeypatch.setattr(ranks, "_ranked_rows", lambda d, c, *a: dealt.extend(c) or rows_of(d, c, *a))
    found = ranks.spearman(df, {n: ranks.clean_double(F.col(n)) for n in names})
    expected = pdf[names].corr(method="spearman")
    assert ("small" in dealt) == (limit == 0) and (limit < 10**6 or not dealt) and (limit != 100 or dealt)
    for (a, b), rho in found.items():
        assert rho is None if "same" in (a, b) else rho == pytest.approx(expected.loc[a, b], abs=1e-12)
