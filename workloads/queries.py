"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import synthtab as st
from synthtab.functions import distributions as dist
from synthtab.functions.rng import Draw, row_key
from synthtab.functions.text_values import description_value, match_rules
from synthtab.operators import discover
from synthtab.operators import ranks
from synthtab.operators.generate import generate_columns
from synthtab.operators.profile import Profiler
from synthtab.plans import imperfections
from synthtab.plans.jobs import READERS
from synthtab.plans.spec import ColumnSpec, generic_schema
from synthtab.session import stage, staged_path
from synthtab.sources import catalog
from workloads import fixtures as fx
from workloads.fixtures import rounded, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- generation ----------------------------------------------------------------------


def over_parts(spark: SparkSession, folder: str, specs: list[ColumnSpec], seed: int = 42) -> DataFrame:
    """Columns generated for the rows of ``part``."""
    part = table(spark, folder, "part")
    df = generate_columns(part, specs, "p_partkey", F.col("p_partkey") + 1, seed, keep=["p_partkey"])
    return rounded(df)


NORMAL = [
    ColumnSpec("free", "numeric", "normal", mean=10.0, std=3.0),
    ColumnSpec("clipped", "numeric", "normal", mean=50.0, std=20.0, min=20.0, max=70.0),
    ColumnSpec("max_only", "numeric", "normal", mean=0.0, std=1.0, max=0.5),
    ColumnSpec("stepped", "numeric", "normal", mean=5.0, std=2.0, precision=0.25),
    ColumnSpec("whole", "integer", "no such hint", mean=100.0, std=15.0),
]
POWERLAW = [
    ColumnSpec("a", "numeric", "powerlaw", mean=50.0, std=30.0, min=0.99, max=500.0),
    ColumnSpec("b", "numeric", "powerlaw", mean=5.0, std=1.0),
    ColumnSpec("c", "numeric", skewness=2.0, mean=0.0, std=0.001),
]
LOGNORMAL = [
    ColumnSpec("a", "numeric", "lognormal", mean=100.0, std=30.0, min=0.0, max=150.0),
    ColumnSpec("b", "numeric", skewness=0.5, mean=4.0, std=2.0, min=1.0),
]
UNIFORM = [
    ColumnSpec("a", "numeric", "uniform", min=-5.0, max=5.0),
    ColumnSpec("b", "integer", "uniform", min=3.0, max=1.0),
]
BOOL_DATE = [
    ColumnSpec("flagged", "boolean", true_ratio=0.7),
    ColumnSpec("day", "datetime"),
    ColumnSpec("swapped", "datetime", min_date="2023-06-01", max_date="2021-01-01"),
]
LEFT = [
    ColumnSpec("a", "numeric", "left_skewed", mean=70.0, min=0.0, max=100.0),
    ColumnSpec("b", "numeric", skewness=-1.0, mean=9.0, min=5.0, max=10.0),
]
IDS = ["txn_ref", "customer_id", "product_sku", "staff_num", "purchase_num", "account_id"]
CATEGORIES = [
    "city", "country", "item_kind", "segment", "department", "payment_kind_mode", "is_fraud", "status",
    "gender", "grade", "is_active", "last_name",
]
PEOPLE = ["full_name", "email", "mobile", "website"]


@query
def gen_normal(spark, folder):
    return over_parts(spark, folder, NORMAL)


@query
def gen_powerlaw(spark, folder):
    return over_parts(spark, folder, POWERLAW)


@query
def gen_powerlaw_sample_scaled(spark, folder):
    part = table(spark, folder, "part")
    specs = POWERLAW + LOGNORMAL[1:]
    specs = [s.with_(name=f"{s.name}{i}") for i, s in enumerate(specs)]
    df = generate_columns(
        part, specs, "p_partkey", F.col("p_partkey") + 1, 42, keep=["p_partkey"], rescale="sample"
    )
    return rounded(df, 4)


@query
def gen_lognormal(spark, folder):
    return over_parts(spark, folder, LOGNORMAL)


@query
def gen_uniform(spark, folder):
    return over_parts(spark, folder, UNIFORM)


@query
def gen_left_skewed(spark, folder):
    return over_parts(spark, folder, LEFT)


@query
def gen_bool_date(spark, folder):
    df = over_parts(spark, folder, BOOL_DATE)
    return df.select(
        "p_partkey",
        "flagged",
        *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("day", "swapped")],
    )


@query
def gen_placeholders(spark, folder):
    specs = [
        ColumnSpec("custom_note"),
        ColumnSpec("memo", template="Line"),
        ColumnSpec("thing", "geometry"),
        ColumnSpec("memo", template="Last wins"),
    ]
    return over_parts(spark, folder, specs)


@query
def gen_text_ids(spark, folder):
    return over_parts(spark, folder, [ColumnSpec(c) for c in IDS])


@query
def gen_categories(spark, folder):
    return over_parts(spark, folder, [ColumnSpec(c) for c in CATEGORIES])


@query
def gen_names_emails(spark, folder):
    return over_parts(spark, folder, [ColumnSpec(c) for c in PEOPLE])


@query
def gen_generic_ecommerce(spark, folder):
    df = over_parts(spark, folder, generic_schema("e-commerce"))
    return df.withColumn("order_date", F.unix_micros(F.col("order_date").cast("timestamp")))


@query
def generate_dataset_like_orders(spark, folder):
    """As many rows as ``orders`` has, with the e-commerce profile applied."""
    rows = table(spark, folder, "orders").count()
    df = st.generate_dataset(spark, "e-commerce", rows, seed=7)
    return rounded(df.drop("order_date"))


@query
def text_rule_match(spark, folder):
    names = fx.column_names(spark, folder)
    loose = match_rules(names, "column_name", "description", out="rule")
    return match_rules(loose, "column_name", "description", strict_names=True, out="strict_rule")


@query
def description_values(spark, folder):
    part = table(spark, folder, "part")
    text = F.when(F.col("p_partkey") % 9 == 0, "for the one").otherwise(F.concat(F.lit("This is from "), "p_name"))
    draw = Draw(row_key(part, "p_partkey"), 5, "d")
    return part.select("p_partkey", description_value(text, draw).alias("value"))


@query
def distribution_choice(spark, folder):
    """Distribution chosen from the measured skewness of every numeric column."""
    hints = st.skew_hints(table(spark, folder, "events"))
    more = st.skew_hints(fx.masked_lineitem(spark, folder))
    both = hints.unionByName(more)
    return rounded(both.select("column_name", "skewness", dist.hint_from_skewness(F.col("skewness")).alias("hint")))


# ---- injection -----------------------------------------------------------------------


@query
def inject_mcar(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return st.inject_nulls(orders, fx.PROFILES["mcar"], "o_orderkey", 11)


@query
def inject_mar(spark, folder):
    li = table(spark, folder, "lineitem").select(*fx.LINE_KEY, "l_quantity", "l_tax", "l_returnflag")
    return st.inject_nulls(li, fx.PROFILES["mar"], fx.LINE_KEY, 12).drop("l_shipdate")


@query
def inject_mnar(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return st.inject_nulls(orders, fx.PROFILES["mnar"], "o_orderkey", 13)


@query
def inject_outliers(spark, folder):
    li = table(spark, folder, "lineitem").select(
        *fx.LINE_KEY, "l_extendedprice", "l_quantity", "l_discount", "l_linestatus"
    )
    return rounded(st.inject_outliers(li, fx.PROFILES["outliers"], fx.LINE_KEY, 14).drop("l_shipdate"))


@query
def inject_noise(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return rounded(st.inject_noise(orders, fx.PROFILES["noise"], "o_orderkey", 15))


@query
def apply_profile(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    return rounded(st.apply_profile(events, fx.PROFILES["all"], "event_id", 16))


# ---- profiling -----------------------------------------------------------------------


@query
def basic_stats_orders(spark, folder):
    return rounded(st.basic_stats(table(spark, folder, "orders")), 4)


@query
def null_pairs_masked(spark, folder):
    return rounded(st.null_pairs(fx.masked_lineitem(spark, folder)))


@query
def iqr_outliers_events(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return rounded(st.iqr_outliers(events).drop("weekend_concentration"))


@query
def outlier_weekend_events(spark, folder):
    return rounded(st.iqr_outliers(table(spark, folder, "events"), date_col="ts"))


@query
def iqr_outliers_injected(spark, folder):
    li = table(spark, folder, "lineitem").select(*fx.LINE_KEY, "l_extendedprice", "l_quantity", "l_discount")
    bad = st.inject_outliers(li, fx.PROFILES["outliers"], fx.LINE_KEY, 14)
    bad = stage(bad.select("l_extendedprice", "l_quantity", "l_discount", "l_shipdate"))
    return rounded(st.iqr_outliers(bad))


@query
def skew_hints_lineitem(spark, folder):
    return rounded(st.skew_hints(table(spark, folder, "lineitem")))


@query
def null_links_masked(spark, folder):
    return st.null_links(fx.masked_lineitem(spark, folder))


@query
def value_shifts_masked(spark, folder):
    found = st.value_shifts(fx.masked_lineitem(spark, folder))
    return rounded(found.withColumn("p_value", F.round("p_value", 4)))


@query
def ks_split_lineitem(spark, folder):
    """KS distance of quantity and price between returned and other lines."""
    li = table(spark, folder, "lineitem")
    marked = li.select(
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("kept"), "l_quantity", "l_extendedprice"
    )
    return rounded(st.value_shifts(marked).drop("p_value"))


@query
def missingness_masked(spark, folder):
    found = st.missingness(fx.masked_lineitem(spark, folder))
    links = F.coalesce(F.size("correlated_with"), F.lit(0)).cast("bigint")
    return rounded(found.select("column_name", "pattern", "null_pct", links.alias("links"), "global_summary"))


@query
def rounding_share_orders(spark, folder):
    return rounded(st.noise(table(spark, folder, "orders")))


@query
def min_gap_part(spark, folder):
    return rounded(st.noise(table(spark, folder, "part")))


@query
def fingerprint_lineitem(spark, folder):
    return rounded(st.fingerprint_frame(fx.masked_lineitem(spark, folder)))


@query
def fingerprint_events(spark, folder):
    return rounded(st.fingerprint_frame(table(spark, folder, "events"), date_col="ts"))


@query
def profile_columns_orders(spark, folder):
    return rounded(st.profile_columns(table(spark, folder, "orders")))


@query
def profile_columns_masked(spark, folder):
    return rounded(st.profile_columns(fx.masked_lineitem(spark, folder)), 4)


@query
def scan_tables(spark, folder):
    """Column statistics of four whole tables, measured in the same jobs."""
    found = st.profile_sources({name: table(spark, folder, name) for name in fx.SCANNED})
    return rounded(found.drop("position"))


# ---- files -------------------------------------------------------------------------------


fresh = staged_path


@query
def csv_round_trip(spark, folder):
    """Whole texts with quotes, delimiters and line breaks, written and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    quoted = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('say "hi", ; '), "text")).when(F.col("doc_id") % 7 == 0, F.lit(""))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 11 != 0, F.coalesce(quoted, "text")))
    path = fresh(spark, "csv")
    st.write_csv(docs, path)
    return st.read_delimited(spark, path, schema="doc_id bigint, text string, lang string, source string")


@query
def csv_types_orders(spark, folder):
    """Types inferred from a file, with the catalog's names for them."""
    path = fresh(spark, "csv")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    st.write_csv(orders, path)
    return st.infer_columns(st.read_delimited(spark, path)).select("position", "column_name", "data_type")


@query
def folder_of_csv(spark, folder):
    """All files of a folder: two delimiters, several files each, columns matched by name, one type for each over all."""
    path = fresh(spark, "folder")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), F.format_string("%08d", "o_orderkey").alias("code"),
        F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 3 == 0, "1.50").alias("note"),
    )
    st.write_csv(orders.repartition(3, "order_key"), f"{path}/a")
    other = table(spark, folder, "customer").select(
        F.col("c_name").alias("code"), F.col("c_custkey").alias("cust_key"), F.lit("n/a").alias("note"), F.col("c_acctbal").alias("amount")
    )
    other.repartition(2, "cust_key").write.option("header", True).option("sep", ";").csv(f"{path}/b")
    df = READERS["folder"](spark, path)
    keys = [F.col(c).cast("bigint").alias(c) for c in ("order_key", "cust_key")]
    return df.select(*keys, "code", "amount", "note")


@query
def json_round_trip(spark, folder):
    path = fresh(spark, "json")
    st.write_json(table(spark, folder, "documents").select("doc_id", "text", "n_chars"), path)
    return spark.read.schema("doc_id bigint, text string, n_chars bigint").json(path)


@query
def parquet_round_trip(spark, folder):
    path = fresh(spark, "parquet")
    st.write_parquet(table(spark, folder, "customer"), path)
    return spark.read.parquet(path)


@query
def cleaned_names(spark, folder):
    names = ["key!", "ke(y", "%", "acct bal", "price?"]
    return st.clean_columns(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").toDF(*names))


# ---- reports ---------------------------------------------------------------------------


@query
def preview_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return st.preview(orders, "o_orderkey")


@query
def table_summary(spark, folder):
    return st.table_summary(fx.masked_lineitem(spark, folder))


@query
def worst_nulls(spark, folder):
    return rounded(st.worst_nulls(fx.masked_lineitem(spark, folder)))


@query
def outlier_counts_events(spark, folder):
    return rounded(st.outlier_counts(table(spark, folder, "events")))


@query
def describe_customer(spark, folder):
    return st.column_statistics(table(spark, folder, "customer"))


@query
def describe_events(spark, folder):
    return st.column_statistics(table(spark, folder, "events"))


# ---- quality ---------------------------------------------------------------------------


def measured_specs(spark: SparkSession, folder: str) -> list[ColumnSpec]:
    """Specs with the (rounded) statistics of ``orders``."""
    p = Profiler(table(spark, folder, "orders").select("o_totalprice", "o_custkey"))
    return [
        ColumnSpec(
            c,
            "numeric",
            "normal",
            mean=round(p.scan.mean[c], 2),
            std=round(p.scan.std[c], 2),
            min=p.scan.extents[c].low,
            max=p.scan.extents[c].high,
        )
        for c in p.numeric
    ]


@query
def reference_sample_orders(spark, folder):
    return rounded(st.reference_sample(spark, measured_specs(spark, folder)), 4)


@query
def ks_quality_orders(spark, folder):
    return st.column_scores(table(spark, folder, "orders"), measured_specs(spark, folder))


@query
def null_drift_masked(spark, folder):
    specs = [
        ColumnSpec("tax_mcar", "text", null_ratio=0.2),
        ColumnSpec("price_mar", "text", null_ratio=0.3),
        ColumnSpec("flag_b", "text"),
        ColumnSpec("l_quantity", "text"),
    ]
    return st.column_scores(fx.masked_lineitem(spark, folder), specs).drop("ks")


def correlations(df: DataFrame) -> DataFrame:
    names = df.columns
    found = ranks.spearman(df, {c: F.col(c) for c in names})
    rows = [(a, b, r) for (a, b), r in found.items()]
    return rounded(df.sparkSession.createDataFrame(rows, "a string, b string, rho double"))


@query
def spearman_lineitem(spark, folder):
    """All eight numeric columns."""
    li = table(spark, folder, "lineitem")
    return correlations(li.select(*fx.LINEITEM_NUMERIC))


@query
def spearman_masked(spark, folder):
    df = fx.masked_lineitem(spark, folder)
    return correlations(df.select("l_quantity", "l_discount", "tax_mcar", "price_mar", "fee_mnar"))


@query
def quality_generated(spark, folder):
    """Score of a batch generated for the rows of ``orders``, with nulls in one column."""
    orders = table(spark, folder, "orders")
    key = "o_orderkey"
    df = generate_columns(orders, fx.BATCH, key, F.col(key) + 1, 77, keep=[key])
    df = st.inject_nulls(df, {"null_patterns": {"fee": {"null_pct": 9.0, "pattern": "MCAR"}}}, key, 77)
    return st.score_frame(stage(df.drop(key)), fx.BATCH)


class StoredProfile:
    """A catalog that holds one profile."""

    def profile_json(self, domain: str) -> str:
        return json.dumps({"null_patterns": {"fee": {"null_pct": fx.FEE_NULLS, "pattern": "MCAR"}}, "null_correlations": []})


@query
def batched_generation(spark, folder):
    """Three batches totalling the rows of ``orders`` in two waves: every batch is made twice, and what the first wave measures changes the second."""
    rows = table(spark, folder, "orders").count()
    made = st.batched_generate(
        spark, "custom", rows, -(-rows // 3), fx.FLAT_BATCH, seed=5, threshold=2.0, retries=1, staged=True, catalog=StoredProfile(), wave=2
    )
    return rounded(made.data)


@query
def batch_union(spark, folder):
    """Two batches with numbering that goes on."""
    rows = table(spark, folder, "part").count()
    specs = [ColumnSpec("note"), ColumnSpec("x", "numeric", "uniform")]
    first = st.generate(spark, specs, rows, 1)
    return rounded(first.unionByName(st.generate(spark, specs, rows, 2, first_row=rows)))


# ---- profiles and catalog --------------------------------------------------------------


@query
def profile_merge(spark, folder):
    merged = imperfections.merge_profile_rows(
        fx.profile_table(spark, folder, "a"), fx.profile_table(spark, folder, "b")
    )
    return merged.select(
        "domain",
        "column_name",
        "section",
        *[F.col("attrs")[k].alias(k) for k in ("pattern", "direction")],
        *[
            F.round(F.col("attrs")[k].cast("double"), 4).alias(k)
            for k in ("null_pct", "outlier_pct", "skewness", "precision")
        ],
    )


@query
def profile_from_json(spark, folder):
    """Stored JSON of every customer's profile, read back into rows."""
    number = F.col("c_custkey")
    text = F.when(number % 10 == 3, F.lit("{not json")).otherwise(
        F.concat(
            F.lit('{"null_patterns": {"c'), (number % 4).cast("string"),
            F.lit('": {"null_pct": '), (number % 50).cast("string"),
            F.lit(', "pattern": "MAR"}}, "skew_profiles": {}}'),
        )
    )
    stored = table(spark, folder, "customer").select(F.col("c_name").alias("domain"), text.alias("profile_json"))
    rows = imperfections.profiles_from_json(stored)
    return rows.select(
        "domain", "column_name", "section",
        F.col("attrs")["null_pct"].alias("null_pct"), F.col("attrs")["pattern"].alias("pattern"),
    )


@query
def domain_upsert(spark, folder):
    incoming = table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("new "), "c_mktsegment")).alias("name"),
        F.concat(F.lit("d "), F.col("c_name")).alias("description"),
        F.lit(None).cast("bigint").alias("parent_domain_id"),
        F.lit(fx.EPOCH).cast("timestamp").alias("created_at"),
    )
    merged = catalog.upsert_domains(fx.catalog_domains(spark, folder), incoming)
    return merged.select("id", "name", "description")


@query
def domain_list(spark, folder):
    domains = fx.catalog_domains(spark, folder)
    return domains.select("id", "name", "description").orderBy("name")


def micros(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.unix_micros(name))


@query
def dataset_latest(spark, folder):
    merged = catalog.upsert_datasets(fx.catalog_datasets(spark, folder), fx.rescanned_datasets(spark, folder))
    return micros(merged, "crawled_at")


@query
def dataset_newest(spark, folder):
    return micros(catalog.list_datasets(fx.catalog_datasets(spark, folder), None, 100), "crawled_at")


@query
def column_upsert(spark, folder):
    old = fx.one_row_per_column(fx.catalog_columns(spark, folder))
    new = fx.one_row_per_column(fx.catalog_columns(spark, folder, step=2, shift=1000))
    return rounded(catalog.put_columns(old, new))


@query
def domain_schema_merge(spark, folder):
    merged = catalog.merged_schema(
        fx.catalog_domains(spark, folder),
        fx.catalog_datasets(spark, folder),
        fx.one_row_per_column(fx.catalog_columns(spark, folder)),
    )
    return rounded(merged.drop("seen"))


@query
def catalog_counts(spark, folder):
    profiles = table(spark, folder, "region").selectExpr("r_regionkey as domain_id", "r_name as profile_json")
    return catalog.catalog_counts(
        fx.catalog_domains(spark, folder),
        fx.catalog_datasets(spark, folder),
        fx.catalog_columns(spark, folder),
        profiles,
    )


@query
def profile_upsert(spark, folder):
    old = table(spark, folder, "customer").selectExpr("c_custkey as domain_id", "c_name as profile_json")
    new = table(spark, folder, "part").selectExpr("p_partkey * 2 as domain_id", "p_name as profile_json")
    return catalog.upsert_profiles(old, new)


@query
def cache_write(spark, folder):
    """Later answers replace earlier ones of the same description."""
    rows = fx.cached_answers(spark, folder)
    again = rows.withColumns(
        {
            "response": F.concat(F.lit("again "), "response"),
            "created_at": F.col("created_at") + F.expr("INTERVAL 10 HOURS"),
        }
    )
    return micros(micros(catalog.cache_put(rows, again), "created_at"), "expires_at")


@query
def cache_lookup(spark, folder):
    requests = fx.descriptions(spark, folder)
    key = catalog.cache_key(discover.strip(F.col("text")))
    found = catalog.cache_get(requests, fx.cache_table(spark, folder), key, fx.moment(F.lit(fx.NOW_HOURS)))
    return found.select("id", "response")


# ---- discovery ---------------------------------------------------------------------------


@query
def route_descriptions(spark, folder):
    return discover.route_domains(fx.descriptions(spark, folder), "text").select("id", "domain")


@query
def clean_documents(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", discover.clean_description(F.col("text")).alias("cleaned"))


@query
def schema_from_responses(spark, folder):
    parsed = discover.parse_answers(fx.responses(spark, folder), "response")
    return rounded(discover.explode_specs(parsed, ["id"]).withColumn("position", F.col("position").cast("bigint")))


@query
def answer_validity(spark, folder):
    """Validity predicates over answers read without checks."""
    read = F.from_json("response", discover.ANSWER.removeprefix("struct<").removesuffix(">"))
    df = fx.responses(spark, folder).withColumn("a", read)
    return df.select("id", discover.is_valid_answer(F.col("a")).alias("valid"))


@query
def resolve_descriptions(spark, folder):
    requests = fx.descriptions(spark, folder).join(
        fx.responses(spark, folder).select("id", "response"), "id"
    )
    specs = discover.catalog_specs(
        fx.catalog_domains(spark, folder),
        fx.catalog_datasets(spark, folder),
        fx.one_row_per_column(fx.catalog_columns(spark, folder)),
    )
    found = discover.resolve_descriptions(
        requests, "text", specs, fx.cache_table(spark, folder), "response", fx.moment(F.lit(fx.NOW_HOURS))
    )
    return found.select(
        "id",
        "source",
        "domain",
        F.coalesce(F.size("specs"), F.lit(0)).cast("bigint").alias("columns"),
        F.coalesce(F.size("answered"), F.lit(0)).cast("bigint").alias("answered_columns"),
    )


@query
def guard_formulas(spark, folder):
    return rounded(st.guard_formulas(fx.formula_cells(spark, folder)))
