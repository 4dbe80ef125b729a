"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthtab.functions.rng import Draw, row_key
from synthtab.plans.spec import ColumnSpec
from synthtab.sources.catalog import SCHEMAS, cache_key, cache_put, stable_id

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    return df.select(
        *[
            F.round(c.name, places).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
            for c in df.schema.fields
        ]
    )


# ---- lineitem with nulls ---------------------------------------------------------


def masked_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    draw = Draw(row_key(li, ["l_orderkey", "l_linenumber", "l_partkey"]), 1, "tax").u1
    return li.select(
        "l_quantity",
        "l_discount",
        F.when(draw >= 0.2, F.col("l_tax")).alias("tax_mcar"),
        F.when(F.col("l_quantity") <= 40, F.col("l_extendedprice")).alias("price_mar"),
        F.when(
            (F.col("l_quantity") <= 45) & (F.col("l_discount") <= 0.08),
            F.col("l_extendedprice") * F.col("l_tax"),
        ).alias("fee_mnar"),
        F.when(F.col("l_linenumber") > 2, F.col("l_shipdate")).alias("ship_a"),
        F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")).alias("flag_b"),
    )


# ---- texts -------------------------------------------------------------------------

WORDS = [
    "e-commerce", "healthcare", "finance", "education", "social-media", "iot-sensors",
    "real-estate", "transportation", "energy drinks", "manufacturing", "retail", "nothing",
]
NAMES = [
    "order_id", "purchase-num", "first_name", "capacity", "estate", "payment_method", "email",
    "custom_note", "Item Category", "is_fraud", "home_phone", "website", "account_num", "prototype",
    "country_code", "gender", "user_name", "grade", "shipping address", "dept", "surname", "naïve",
]
HINTS = ["the customer email", "a department of the firm", "free words", "status of the order"]


def choose(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    text = F.concat_ws(" ", F.lit(" "), F.upper("p_name"), choose(WORDS, F.col("p_partkey")), F.lit("\tdata "))
    return part.select(F.col("p_partkey").alias("id"), text.alias("text"))


def column_names(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    number = F.col("p_partkey")
    name = F.when(number % 5 == 4, F.translate("p_name", " ", "_")).otherwise(choose(NAMES, number))
    return part.select(
        number.alias("id"),
        name.alias("column_name"),
        F.when(number % 3 == 0, choose(HINTS, F.floor(number / 3))).alias("description"),
    )


def formula_cells(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    sign = F.element_at(
        F.array(*[F.lit(v) for v in ("=", "+", "-", "@", "a")], F.lit(None)),
        (F.col("o_orderkey") % 6 + 1).cast("int"),
    )
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(sign, F.col("o_orderpriority")).alias("s"),
        F.col("o_orderstatus").alias("t"),
        (-F.col("o_totalprice")).alias("x"),
    )


def answer_json(number: Column) -> Column:
    """A two-column answer whose values depend on the row."""
    return F.concat(
        F.lit('{"domain": "'),
        F.when(number % 2 == 0, "AUTOMOBILE").otherwise("unknown"),
        F.lit('", "domain_description": "parts", "columns": [{"column_name": "c'),
        number.cast("string"),
        F.lit('", "data_type": "numeric", "description": "size", "distribution_hint": "", "min": 0, "max": '),
        (number + 1).cast("string"),
        F.lit(', "null_ratio": '),
        F.when(number % 7 == 0, "1.5").otherwise("0.25"),
        F.lit('}, {"column_name": "label", "data_type": "text", "description": "name"}]}'),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("p_partkey")
    body = answer_json(number)
    form = number % 6
    text = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone {x}.")))
        .when(form == 2, F.concat(F.lit("```\n"), body, F.lit("\n``` ok")))
        .when(form == 3, F.concat(F.lit("Here it is "), body, F.lit(" as asked.")))
        .when(form == 4, F.expr("substring(b, 1, length(b) - 3)"))
        .otherwise(F.regexp_replace("b", '"columns"', '"fields"'))
    )
    return (
        table(spark, folder, "part")
        .withColumn("b", body)
        .select(number.alias("id"), F.concat_ws(" ", "p_name", F.lit("table")).alias("text"), text.alias("response"))
    )


# ---- catalog tables --------------------------------------------------------------


def url_of(number: Column) -> Column:
    return F.concat(F.lit("mem://cust/"), number.cast("string"))


def moment(hours: Column) -> Column:
    """Whole hours after a fixed start."""
    return F.timestamp_add("HOUR", hours.cast("int"), F.lit(EPOCH).cast("timestamp"))


def catalog_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Market segments are the domains already known."""
    segments = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return segments.select(
        stable_id(F.col("name")).alias("id"),
        "name",
        F.concat(F.lit("known "), F.col("name")).alias("description"),
        F.lit(None).cast("bigint").alias("parent_domain_id"),
        F.lit(EPOCH).cast("timestamp").alias("created_at"),
    )


def catalog_datasets(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    number = F.col("c_custkey")
    return customer.select(
        stable_id(url_of(number)).alias("id"),
        F.lit("url").alias("source"),
        url_of(number).alias("source_url"),
        stable_id(F.col("c_mktsegment")).alias("domain_id"),
        F.col("c_name").alias("dataset_name"),
        (number + 10).alias("row_count"),
        (number % 7).alias("column_count"),
        moment(number % 97).alias("crawled_at"),
    )


def rescanned_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as later scans of their customer's dataset; many per dataset."""
    number = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.lit("again").alias("source"),
        url_of(F.col("o_custkey") * 2).alias("source_url"),
        stable_id(F.col("o_orderpriority")).alias("domain_id"),
        F.concat(F.lit("order "), number.cast("string")).alias("dataset_name"),
        number.alias("row_count"),
        (number % 5).alias("column_count"),
        moment(F.lit(200) + number % 89).alias("crawled_at"),
    )


def catalog_columns(spark: SparkSession, folder: str, step: int = 1, shift: int = 0) -> DataFrame:
    """Orders as columns of the dataset of every ``step``-th customer."""
    number = F.col("o_orderkey")
    price = F.col("o_totalprice")

    def unless(divisor: int, value: Column) -> Column:
        return F.when(number % divisor != 0, value)

    return table(spark, folder, "orders").select(
        stable_id(url_of(F.col("o_custkey") * step)).alias("dataset_id"),
        F.concat(F.lit("col_"), (number % 9).cast("string")).alias("column_name"),
        F.lit("").alias("column_description"),
        F.when(F.col("o_orderstatus") == "O", "text").otherwise("numeric").alias("data_type"),
        unless(4, (number % 10) / F.lit(10.0)).alias("null_ratio"),
        number.alias("distinct_count"),
        unless(2, price + F.lit(shift)).alias("mean"),
        unless(3, price / F.lit(2.0)).alias("std"),
        unless(5, -price).alias("min"),
        F.when(number % 11 == 0, price * 2).alias("max"),
        number.cast("string").alias("sample_values"),
        number.cast("int").alias("position"),
    )


def one_row_per_column(columns: DataFrame) -> DataFrame:
    """The catalog keeps one row per (dataset, column)."""
    first = F.struct("sample_values")
    keys = ["dataset_id", "column_name"]
    names = columns.columns
    picks = [F.max_by(c, first).alias(c) for c in names if c not in keys]
    return columns.groupBy(*keys).agg(*picks).select(*names)


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers for two of three descriptions (the others under another text),
    some expired, some unreadable."""
    number = F.col("id")
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    key = cache_key(F.when(number % 3 == 0, F.concat(text, F.lit(" other"))).otherwise(text))
    answer = F.when(number % 5 == 1, F.lit("{broken")).otherwise(answer_json(number))
    return (
        descriptions(spark, folder)
        .select(
            key.alias("cache_key"),
            F.lit("m").alias("model"),
            answer.alias("response"),
            moment(number % 50).alias("created_at"),
            moment(F.lit(720) + number % 50).alias("expires_at"),
        )
    )


def cache_table(spark: SparkSession, folder: str) -> DataFrame:
    """The cache after all answers were put: one per description text."""
    return cache_put(spark.createDataFrame([], SCHEMAS["cache"]), cached_answers(spark, folder))


NOW_HOURS = 745


def profile_table(spark: SparkSession, folder: str, side: str) -> DataFrame:
    """Profiles from customers (side a) and parts (side b); the two overlap in part."""
    source, key, first = ("customer", "c_custkey", 0) if side == "a" else ("part", "p_partkey", 500)
    number = F.col(key) + F.lit(first)
    section = choose(["null_patterns", "outlier_patterns", "skew_profiles", "noise_patterns"], number)
    offset = 0.0 if side == "a" else 7.0
    pct = (number % 40 + F.lit(offset)).cast("double")
    attrs = (
        F.when(
            section == "null_patterns",
            F.create_map(F.lit("null_pct"), pct.cast("string"), F.lit("pattern"), F.lit("MAR" if side == "a" else "MCAR")),
        )
        .when(
            section == "outlier_patterns",
            F.create_map(F.lit("direction"), F.lit("high" if side == "a" else "low"), F.lit("outlier_pct"), (pct / 8).cast("string")),
        )
        .when(section == "skew_profiles", F.create_map(F.lit("skewness"), pct.cast("string")))
        .otherwise(F.create_map(F.lit("precision"), pct.cast("string")))
    )
    return table(spark, folder, source).select(
        F.concat(F.lit("domain "), (F.floor(number / 8)).cast("string")).alias("domain"),
        F.concat(F.lit("col "), (number % 8).cast("string")).alias("column_name"),
        section.alias("section"),
        attrs.alias("attrs"),
    )


# ---- schemas and profiles ------------------------------------------------------------

BATCH = [
    ColumnSpec("id", "text"),
    ColumnSpec("price", "numeric", "normal", mean=50.0, std=10.0, min=0.0, max=100.0),
    ColumnSpec("qty", "integer", mean=5.0, std=2.0, min=1.0, max=10.0),
    ColumnSpec("fee", "numeric", "uniform", min=0.0, max=8.0, null_ratio=0.05),
]
# the feedback moves means and null ratios, which these samplers do not use
#: Tables that are profiled together, and whether their columns are numeric.
SCANNED = {
    "customer": {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False},
    "orders": {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False, "o_orderpriority": False},
    "part": {"p_partkey": True, "p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True},
    "supplier": {"s_suppkey": True, "s_name": False, "s_nationkey": True, "s_acctbal": True},
}
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAT_BATCH = [
    ColumnSpec("note"),
    ColumnSpec("price", "numeric", "uniform", min=0.0, max=100.0),
    ColumnSpec("fee", "numeric", "uniform", min=0.0, max=8.0, null_ratio=0.05),
]
#: Percent of nulls that a stored profile asks for, four times the share of the specs.
FEE_NULLS = 20.0
PROFILES = {
    "mcar": {"null_patterns": {"o_totalprice": {"null_pct": 20.0, "pattern": "MCAR"}, "o_orderstatus": {"null_pct": 10.0, "pattern": "OTHER"}}},
    "mar": {
        "null_patterns": {"l_tax": {"null_pct": 30.0, "pattern": "MAR"}, "l_returnflag": {"null_pct": 12.0, "pattern": "MAR"}},
        "null_correlations": [{"cols": ["l_tax", "l_quantity"], "jaccard": 0.5}],
    },
    "mnar": {"null_patterns": {"o_totalprice": {"null_pct": 25.0, "pattern": "MNAR"}, "o_custkey": {"null_pct": 15.0, "pattern": "MNAR"}}},
    "outliers": {
        "outlier_patterns": {
            "l_extendedprice": {"direction": "high", "outlier_pct": 2.0},
            "l_quantity": {"direction": "both", "outlier_pct": 1.0},
            "l_linestatus": {"direction": "both", "outlier_pct": 1.0},
            "l_discount": {"direction": "low", "outlier_pct": 0.5},
        }
    },
    "noise": {
        "noise_patterns": {
            "o_totalprice": {"rounding_pct": 40.0, "precision": 1000.0},
            "o_custkey": {"rounding_pct": 10.0, "precision": 50.0},
            "o_orderpriority": {"rounding_pct": 10.0, "precision": 1.0},
        }
    },
    "all": {
        "null_patterns": {"value": {"null_pct": 8.0, "pattern": "MCAR"}, "event_type": {"null_pct": 5.0, "pattern": "MAR"}},
        "null_correlations": [{"cols": ["event_type", "value"], "jaccard": 0.4}],
        "outlier_patterns": {"value": {"direction": "both", "outlier_pct": 1.5}},
        "noise_patterns": {"value": {"rounding_pct": 25.0, "precision": 0.5}},
    },
}
