import json

import pytest
from pyspark.sql import functions as F

import synthtab as st
from synthtab.plans import imperfections as imp
from synthtab.plans import jobs
from synthtab.sources import catalog as module
from synthtab.sources.catalog import Catalog, cache_key


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def dataset(spark, domain_id, url, name="n", hours=0, rows=1):
    moment = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return spark.createDataFrame(
        [("url", url, domain_id, name, rows, 2)],
        "source string, source_url string, domain_id bigint, dataset_name string, row_count bigint, column_count bigint",
    ).withColumn("crawled_at", moment)


def columns(spark, dataset_id, *rows):
    """Rows of (name, type, mean, std)."""
    return spark.createDataFrame(
        [(dataset_id, n, "", t, None, 3, m, s, None, None, "[]", i) for i, (n, t, m, s) in enumerate(rows)],
        module.SCHEMAS["columns"],
    )


def test_domains_are_added_once(catalog):
    catalog.add_domain("finance", "first")
    catalog.add_domain("finance", "second")
    catalog.add_domain("energy")
    assert [r["name"] for r in catalog.domains().collect()] == ["energy", "finance"]
    row = catalog.domain("finance")
    assert row["description"] == "first"
    assert catalog.domain(id=row["id"])["name"] == "finance"
    assert catalog.domain("nope") is None


def test_datasets_update_in_place(spark, catalog):
    catalog.add_domain("d")
    d = catalog.domain("d")["id"]
    catalog.put_datasets(dataset(spark, d, "u1", "old", 0, 5))
    first = catalog.datasets().first()
    catalog.put_datasets(dataset(spark, d, "u1", "new", 1, 9).withColumn("source", F.lit("other")))
    catalog.put_datasets(dataset(spark, d, "u2", "two", 2))
    rows = catalog.datasets("d").collect()
    assert [r["dataset_name"] for r in rows] == ["two", "new"]
    assert (rows[1]["id"], rows[1]["source"], rows[1]["row_count"]) == (first["id"], "url", 9)
    assert catalog.dataset(first["id"])["dataset_name"] == "new"
    assert catalog.datasets("d", limit=1).count() == 1
    assert catalog.datasets("nope").count() == 0


def test_many_updates_of_one_source_in_one_batch(spark, catalog):
    rows = dataset(spark, 1, "hot", "a", 0).crossJoin(spark.range(500)).withColumn("row_count", F.col("id"))
    rows = rows.withColumn("crawled_at", F.col("crawled_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).drop("id")
    catalog.put_datasets(rows)
    assert [r["row_count"] for r in catalog.datasets().collect()] == [499]


def test_merged_schema(spark, catalog):
    catalog.add_domain("d")
    d = catalog.domain("d")["id"]
    catalog.put_datasets(dataset(spark, d, "old", hours=0))
    catalog.put_datasets(dataset(spark, d, "new", hours=5))
    ids = {r["source_url"]: r["id"] for r in catalog.datasets().collect()}
    catalog.put_columns(columns(spark, ids["old"], ("price", "text", 1.0, 2.0), ("only_old", "boolean", None, None)))
    catalog.put_columns(columns(spark, ids["new"], ("name", "text", None, None), ("price", "numeric", 7.0, None)))
    specs = catalog.domain_specs("d")
    assert [s.name for s in specs] == ["name", "price", "only_old"]
    assert (specs[1].data_type, specs[1].mean, specs[1].std) == ("numeric", 7.0, 2.0)
    assert catalog.domain_specs("nope") is None
    made = st.generate_dataset(spark, "d", 10, catalog=catalog, seed=1)
    assert made.columns == ["name", "price", "only_old"]


def test_scanning_again_replaces_columns(spark, catalog):
    for mean in (1.0, 2.0):
        catalog.put_columns(columns(spark, 5, ("price", "numeric", mean, None)))
    assert [r["mean"] for r in catalog.table("columns").collect()] == [2.0]
    assert catalog.counts() == {"domains": 0, "datasets": 0, "columns": 1, "profiles": 0}


def test_cache(spark, catalog):
    request = spark.createDataFrame([("  A Shop ",), ("other",)], "text string")
    key = cache_key(F.col("text"))

    def put(response, days=30):
        row = spark.createDataFrame([(response,)], "response string")
        row = row.select(cache_key(F.lit("a shop")).alias("cache_key"), F.lit("m").alias("model"), "response")
        catalog.cache_put(row, days)

    def get():
        return {r["text"]: r["response"] for r in catalog.cache_get(request, key).collect()}

    assert get() == {"  A Shop ": None, "other": None}
    put("one")
    put("two")
    assert get() == {"  A Shop ": "two", "other": None}
    put("three", days=-1)
    assert get()["  A Shop "] is None


def test_a_failed_write_leaves_the_table(catalog, tmp_path):
    catalog.add_domain("a")
    (tmp_path / "catalog" / "domains" / "v00000007").mkdir()  # no _SUCCESS
    assert [r["name"] for r in catalog.domains().collect()] == ["a"]
    catalog.add_domain("b")
    assert catalog.domains().count() == 2


# ---- profiles ----------------------------------------------------------------------


def test_default_profiles():
    assert len(imp.DEFAULT_PROFILES) == 10 and list(imp.DEFAULT_PROFILES) == list(imp.SEED_DOMAINS)
    assert imp.default_profile("nope") == {s: {} for s in imp.SECTIONS}
    changed = imp.default_profile("energy")
    changed["null_patterns"].clear()
    assert imp.default_profile("energy")["null_patterns"]


def test_merge_averages_known_nulls():
    existing = {"null_patterns": {"a": {"null_pct": 10.0, "pattern": "MAR"}}}
    found = {
        "null_patterns": {},
        "null_correlations": [{"cols": ["a", "b"]}],
        "missingness": {"columns": {"a": {"null_pct": 20.0, "pattern": "MCAR"}, "b": {"null_pct": 5.0, "pattern": "MNAR"}}},
        "outliers": {"x": {"direction": "high", "outlier_pct": 1.26, "outlier_mean": 4.0}},
        "skew_profiles": {"x": {"skewness": 2.0}},
        "noise": {"x": {"precision": 1.0}},
    }
    merged = imp.merge_profile(existing, found)
    assert merged["null_patterns"] == {"a": {"null_pct": 15.0, "pattern": "MAR"}, "b": {"null_pct": 5.0, "pattern": "MNAR"}}
    assert merged["outlier_patterns"] == {"x": {"direction": "high", "outlier_pct": 1.3}}
    assert merged["noise_patterns"] == {"x": {"precision": 1.0}} and merged["skew_profiles"]
    assert merged["null_correlations"] == [{"cols": ["a", "b"]}]
    assert existing == {"null_patterns": {"a": {"null_pct": 10.0, "pattern": "MAR"}}}


def test_merge_needs_both_null_sections():
    found = {"null_patterns": {"a": {"null_pct": 9.0}}, "missingness": {"columns": {"b": {"null_pct": 1.0}}}}
    assert imp.merge_profile({"null_patterns": {}}, found)["null_patterns"] == {}


def test_profile_rows_merge_like_profiles(spark):
    domain, a = "d", {
        "null_patterns": {"x": {"null_pct": 10.0, "pattern": "MAR"}, "y": {"null_pct": 4.0, "pattern": "MCAR"}},
        "outlier_patterns": {"x": {"direction": "low", "outlier_pct": 2.0}},
        "skew_profiles": {}, "noise_patterns": {"x": {"precision": 0.1}},
    }
    b = {
        "null_correlations": [], "null_patterns": {}, "missingness": {"columns": {"x": {"null_pct": 25.0, "pattern": "MNAR"}}},
        "outlier_patterns": {"x": {"direction": "high", "outlier_pct": 1.24}, "z": {"outlier_pct": 0.5}},
        "skew_profiles": {"x": {"skewness": 1.0}},
    }
    rows_b = {**b, "null_patterns": b["missingness"]["columns"]}
    merged = imp.merge_profile_rows(imp.profile_rows(spark, {domain: a}), imp.profile_rows(spark, {domain: rows_b}))
    expected = imp.profile_rows(spark, {domain: imp.merge_profile(a, b)})

    def as_set(df):
        return {(r["section"], r["column_name"], tuple(sorted(r["attrs"].items()))) for r in df.collect()}

    assert as_set(merged) == as_set(expected)


def test_save_and_load(spark, catalog):
    assert imp.load_profile(catalog, "energy") == imp.default_profile("energy")
    stored = {"outlier_patterns": {"voltage": {"direction": "low", "outlier_pct": 9.0}}}
    imp.save_profile(catalog, "energy", stored)
    loaded = imp.load_profile(catalog, "energy")
    assert loaded["outlier_patterns"]["voltage"] == {"direction": "low", "outlier_pct": 9.0}
    assert loaded["null_patterns"] == imp.default_profile("energy")["null_patterns"]
    imp.save_profile(catalog, "energy", {})
    assert imp.load_profile(catalog, "energy") == imp.default_profile("energy")
    assert catalog.counts()["profiles"] == 1
    assert catalog.domain("energy")["description"] == "Tables about energy"
    catalog.put_profile("energy", "{broken")
    assert imp.load_profile(catalog, "energy") == imp.default_profile("energy")


# ---- jobs -------------------------------------------------------------------------


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    rows = "\n".join(f"{i};{i * 1.5};{'x' if i % 4 else ''}" for i in range(60))
    (tmp_path / "in" / "a.csv").write_text("id;size;label\n" + rows + "\n")
    (tmp_path / "in" / "deep" / "b.csv").write_text("when,n\n2024-01-01,1\n2024-01-02,2\n")
    return tmp_path / "in"


def test_scan_and_analyze(spark, catalog, files):
    sources = {
        "energy": [("url", str(files / "a.csv"), "A"), ("url", str(files / "gone.csv"), "Gone"), ("ftp", "x", "F")],
        "finance": [("folder", str(files / "deep"), "B")],
    }
    assert jobs.scan_and_analyze(catalog, sources, dry_run=True) == {"sources": 4, "domains": 2}
    result = jobs.scan_and_analyze(catalog, sources)
    assert result["status"] == {"ok": 2, "failed": 1, "skipped": 1}
    assert result["counts"] == {"domains": 2, "datasets": 2, "columns": 5, "profiles": 0}
    assert result["fingerprints"]["energy"][0].missingness["columns"]["label"]["null_pct"] == 25.0
    size = catalog.table("columns").filter("column_name = 'size'").first()
    assert (size["data_type"], size["distinct_count"], size["max"]) == ("numeric", 60, 88.5)
    row = catalog.datasets("energy").first()
    assert (row["row_count"], row["column_count"], row["dataset_name"]) == (60, 3, "A")
    again = jobs.scan_sources(catalog, {"energy": sources["energy"][:1]})
    assert [r["status"] for r in again.collect()] == ["ok"]
    assert catalog.counts()["columns"] == 5
    only = jobs.scan_and_analyze(catalog, sources, kind="folder", dry_run=True)
    assert only == {"sources": 1, "domains": 1}


def test_analyze_domains(spark, catalog, files):
    jobs.scan_sources(catalog, {"energy": [("url", str(files / "a.csv"), "A")]})
    assert jobs.analyze_domains(catalog, ["energy", "finance"], dry_run=True) == ["energy", "finance"]
    jobs.analyze_domains(catalog, ["energy", "finance"])
    stored = json.loads(catalog.profile_json("energy"))
    assert stored["null_patterns"] == {"label": {"null_pct": 25.0, "pattern": "MCAR"}}
    assert stored["noise_patterns"]["size"]["precision"] == 1.5
    assert json.loads(catalog.profile_json("finance")) == imp.default_profile("finance")
    listed = {r["name"]: (r["datasets"], r["has_profile"]) for r in jobs.list_profiles(catalog).collect()}
    assert listed == {"energy": (1, True), "finance": (0, True)}
    assert jobs.fingerprint_csv(spark, str(files / "gone.csv")) is None
