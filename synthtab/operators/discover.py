"""From free-text descriptions to column specs, over whole tables of them.

The answers of a language model enter as a text column; nothing here calls
one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthtab.session import stage
from synthtab.plans.imperfections import SEED_DOMAINS
from synthtab.plans.spec import ColumnSpec, generic_schema
from synthtab.sources.catalog import cache_get, cache_key, merged_schema

COLUMN = (
    "struct<column_name string, data_type string, description string, distribution_hint string, "
    "min double, max double, mean double, null_ratio double>"
)
ANSWER = f"struct<domain string, domain_description string, columns array<{COLUMN}>>"
_TEXTS = ("column_name", "data_type", "description", "distribution_hint")
_NUMBERS = ("min", "max", "mean", "null_ratio")
_RAW_COLUMN = ", ".join(f"{n} string" for n in _TEXTS + _NUMBERS)
_READ = f"domain string, domain_description string, columns array<struct<{_RAW_COLUMN}>>, _bad string"

# The column types an answer may use.
ANSWER_TYPES = ["numeric", "integer", "text", "boolean", "datetime"]

_TEXT_FIELDS = "domain|domain_description|column_name|data_type|description|distribution_hint"

SPEC = (
    "struct<column_name string, data_type string, description string, distribution_hint string, "
    "mean double, std double, min double, max double, null_ratio double>"
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def route_domains(df: DataFrame, text: str, out: str = "domain") -> DataFrame:
    """First seed domain (in their fixed order) named in the text, else NULL."""
    lowered = F.lower(strip(F.col(text)))
    found = F.lit(None).cast("string")
    for domain in reversed(SEED_DOMAINS):
        found = F.when(lowered.contains(domain), F.lit(domain)).otherwise(found)
    return df.withColumn(out, found)


def clean_description(text: Column, most: int | None = None) -> Column:
    """Trimmed and without control characters; the whole text, or its first ``most`` characters."""
    cleaned = F.regexp_replace(strip(text), r"[\x00-\x1f\x7f]", "")
    return cleaned if most is None else F.substring(cleaned, 1, most)


# ---- answers --------------------------------------------------------------------


def fenced_json(text: Column) -> Column:
    """The part of an answer that should hold the JSON."""
    text = strip(text)
    marked = strip(F.split_part(F.split_part(text, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
    chunks = F.filter(F.transform(F.split(text, "```"), strip), lambda c: c.contains("{"))
    longest = F.reduce(chunks, F.lit(""), lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best))
    return (
        F.when(text.contains("```json"), marked)
        .when(text.contains("```") & (F.size(chunks) > 0), longest)
        .otherwise(text)
    )


def is_valid_answer(answer: Column) -> Column:
    """Domain, its description and at least one well-formed column."""
    columns = answer["columns"]
    good = F.forall(
        columns,
        lambda c: c["column_name"].isNotNull()
        & F.coalesce(c["data_type"].isin(ANSWER_TYPES), F.lit(False))
        & c["description"].isNotNull()
        & F.coalesce(c["null_ratio"].between(0.0, 1.0), F.lit(True)),
    )
    valid = (
        answer["domain"].isNotNull()
        & answer["domain_description"].isNotNull()
        & (F.size(columns) >= 1)
        & good
    )
    return F.coalesce(valid, F.lit(False))


def _number(value: Column) -> Column:
    """A JSON scalar as double; NULL if it is no number."""
    return F.when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0)).otherwise(value.try_cast("double"))


def parse_answers(df: DataFrame, text: str, out: str = "answer") -> DataFrame:
    """Add the validated answer (see ``ANSWER``) of a response text, NULL if none.

    The JSON object starts at the first brace of the fenced part; whatever
    follows the object is commentary.  Numbers may be written as text, text
    must be text.
    """
    body, read, typed = F.col("_body"), F.col("_read"), F.col("_typed")
    # projections of their own, so that every step is computed once a row
    staged = df.withColumn("_body", fenced_json(F.col(text)))
    start = F.when(body.contains("{"), F.expr("substring(_body, locate('{', _body))"))
    staged = staged.withColumn("_body", start)
    options = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    staged = staged.withColumn("_read", F.from_json(body, _READ, options))
    columns = F.transform(
        read["columns"],
        lambda c: F.struct(*[c[n] for n in _TEXTS], *[_number(c[n]).alias(n) for n in _NUMBERS]),
    )
    answer = F.struct(read["domain"], read["domain_description"], columns.alias("columns"))
    staged = staged.withColumn("_typed", answer.cast(ANSWER))
    numbers = F.forall(
        F.arrays_zip(read["columns"].alias("r"), typed["columns"].alias("t")),
        lambda z: reduce(Column.__and__, [z["r"][n].isNull() | z["t"][n].isNotNull() for n in _NUMBERS]),
    )
    # the object alone: what follows it is commentary
    own = F.get_json_object(body, "$")
    texts = ~own.rlike(rf'"({_TEXT_FIELDS})"\s*:\s*(?!null\b)[^"\s]')
    valid = read["_bad"].isNull() & texts & is_valid_answer(typed) & numbers
    staged = staged.withColumn(out, F.when(F.coalesce(valid, F.lit(False)), typed))
    return staged.drop("_body", "_read", "_typed")


# ---- specs -----------------------------------------------------------------------


def spec_array(columns: Column) -> Column:
    """Answer columns as spec structs; an empty hint is dropped."""
    return F.transform(
        columns,
        lambda c: F.struct(
            c["column_name"],
            c["data_type"],
            F.coalesce(c["description"], F.lit("")).alias("description"),
            F.nullif(c["distribution_hint"], F.lit("")).alias("distribution_hint"),
            c["mean"].alias("mean"),
            F.lit(None).cast("double").alias("std"),
            c["min"].alias("min"),
            c["max"].alias("max"),
            c["null_ratio"].alias("null_ratio"),
        ),
    ).cast(f"array<{SPEC}>")


def explode_specs(df: DataFrame, keep: list[str], answer: str = "answer") -> DataFrame:
    """One row per column of a valid answer."""
    specs = spec_array(F.col(answer)["columns"])
    return df.select(*keep, F.posexplode(specs).alias("position", "c")).select(*keep, "position", "c.*")


def _spec_literal(spec: ColumnSpec) -> Column:
    texts = [spec.name, spec.data_type, spec.description, spec.distribution_hint]
    numbers = [spec.mean, spec.std, spec.min, spec.max, spec.null_ratio]
    return F.struct(
        *[F.lit(t).cast("string") for t in texts], *[F.lit(n).cast("double") for n in numbers]
    ).cast(SPEC)


def generic_specs(domain: Column) -> Column:
    """The generic schema of a seed domain."""
    out = F.array(*[_spec_literal(s) for s in generic_schema("")])
    for name in SEED_DOMAINS:
        if generic_schema(name) != generic_schema(""):
            specs = F.array(*[_spec_literal(s) for s in generic_schema(name)])
            out = F.when(domain == name, specs).otherwise(out)
    return F.when(domain.isNotNull(), out)


def catalog_specs(domains: DataFrame, datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """(domain, specs): the merged schema of every domain that has datasets."""
    merged = merged_schema(domains, datasets, columns)
    entry = F.struct(
        F.col("column_name"),
        F.col("data_type"),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        *[F.col(s) for s in ("mean", "std", "min", "max", "null_ratio")],
    ).cast(SPEC)
    ordered = F.array_sort(
        F.collect_list(F.struct("seen", "column_name", entry.alias("spec"))),
        lambda a, b: F.when(a["seen"] > b["seen"], -1).when(a["seen"] < b["seen"], 1).otherwise(0),
    )
    return merged.groupBy("domain").agg(F.transform(ordered, lambda e: e["spec"]).alias("specs"))


def resolve_descriptions(
    df: DataFrame,
    text: str,
    specs_by_domain: DataFrame,
    cache: DataFrame,
    response: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Specs for every description, from the first place that has them.

    1. a seed domain named in the text: its catalog schema, else its generic one;
    2. an unexpired, valid cached answer;
    3. the response text: the catalog schema of the answered domain if there
       is one (the answered columns are then kept aside), else its columns.

    Adds ``source``, ``domain``, ``specs`` and ``answered`` (NULL where unused).
    """
    now = F.now() if now is None else now
    names = df.columns
    step = route_domains(df, text, "_routed")
    step = cache_get(step, cache, cache_key(strip(F.col(text))), now, "_cached_text")
    step = parse_answers(step, "_cached_text", "_cached")
    if response is None:
        step = step.withColumn("_answer", F.lit(None).cast(ANSWER))
    else:
        # most rows are routed or cached: only the rest is parsed
        needed = F.when(F.col("_routed").isNull() & F.col("_cached").isNull(), F.col(response))
        step = parse_answers(step.withColumn("_needed", needed), "_needed", "_answer")
    source = (
        F.when(F.col("_routed").isNotNull(), "catalog")
        .when(F.col("_cached").isNotNull(), "cache")
        .when(F.col("_answer").isNotNull(), "response")
        .otherwise("none")
    )
    step = step.withColumn("source", source)
    asked = F.when(F.col("source") == "catalog", F.col("_routed")).when(
        F.col("source") == "response", F.col("_answer.domain")
    )
    # A dozen domains and null are asked for by all rows.  The specs are staged, so their size is known: a small table is
    # broadcast, beside a large one adaptive execution cuts the rows of a frequent domain into several tasks.
    known = stage(specs_by_domain.select(F.col("domain").alias("_domain"), F.col("specs").alias("_known")))
    step = step.withColumn("_asked", asked)
    step = step.join(known, step["_asked"] == known["_domain"], "left")
    answered = F.when(F.col("source") == "response", spec_array(F.col("_answer.columns")))
    specs = (
        F.when(F.col("source") == "catalog", F.coalesce("_known", generic_specs(F.col("_routed"))))
        .when(F.col("source") == "cache", spec_array(F.col("_cached.columns")))
        .otherwise(F.coalesce(F.col("_known"), answered))
    )
    domain = F.coalesce("_routed", "_cached.domain", "_answer.domain")
    return step.select(
        *names,
        "source",
        F.when(F.col("source") != "none", domain).alias("domain"),
        specs.alias("specs"),
        answered.alias("answered"),
    )


def answers_for_cache(df: DataFrame, text: str, response: str, model: str = "") -> DataFrame:
    """Rows for ``cache_put`` from descriptions with valid responses."""
    parsed = parse_answers(df, response, "_answer").filter(F.col("_answer").isNotNull())
    return parsed.select(
        cache_key(strip(F.col(text))).alias("cache_key"),
        F.lit(model).alias("model"),
        F.to_json("_answer").alias("response"),
    )
