import json

import pytest
from pyspark.sql import functions as F

from synthtab.functions.text_values import description_value, match_rules
from synthtab.functions.rng import Draw, row_key
from synthtab.operators import discover
from synthtab.sources.catalog import SCHEMAS, cache_put

GOOD = {
    "domain": "bikes",
    "domain_description": "d",
    "columns": [{"column_name": "a", "data_type": "numeric", "description": "q", "min": 1, "null_ratio": 0.2}],
}


def changed(**column):
    out = json.loads(json.dumps(GOOD))
    for k, v in column.items():
        if v is None:
            del out["columns"][0][k]
        else:
            out["columns"][0][k] = v
    return json.dumps(out)


PLAIN = json.dumps(GOOD)
CASES = {
    "plain": (PLAIN, True),
    "fence": (f"Sure\n```json\n{PLAIN}\n```\nbye", True),
    "bare fence": (f"```\n{PLAIN}\n```", True),
    "two fences": ("```{}```" + f" text ```{PLAIN}```", True),
    "comment around": (f"See {PLAIN} and {{more}}", True),
    "text number": (changed(min="7"), True),
    "extra key": (changed(unit="kg"), True),
    "no number": (changed(min="many"), False),
    "broken": (PLAIN[:-2], False),
    "prose": ("no schema here", False),
    "no columns": (json.dumps({**GOOD, "columns": []}), False),
    "missing columns": (json.dumps({"domain": "a", "domain_description": "b"}), False),
    "missing description": (changed(description=None), False),
    "bad type": (changed(data_type="Numeric"), False),
    "ratio too high": (changed(null_ratio=1.2), False),
    "name is a number": (changed(column_name=5), False),
    "empty": ("", False),
    "null": (None, False),
}


def test_answers(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "k string, t string")
    found = {r["k"]: r["answer"] for r in discover.parse_answers(df, "t").collect()}
    assert {k: a is not None for k, a in found.items()} == {k: ok for k, (_, ok) in CASES.items()}
    assert found["text number"]["columns"][0]["min"] == 7.0
    for k in ("plain", "fence", "bare fence", "two fences", "comment around"):
        assert found[k]["columns"][0]["column_name"] == "a" and found[k]["domain"] == "bikes"


def test_explode_drops_empty_hints(spark):
    df = spark.createDataFrame([(1, changed(distribution_hint=""))], "id int, t string")
    row = discover.explode_specs(discover.parse_answers(df, "t"), ["id"]).first()
    assert (row["column_name"], row["min"], row["distribution_hint"], row["null_ratio"]) == ("a", 1.0, None, 0.2)


def test_routing(spark):
    texts = {"  My E-Commerce shop": "e-commerce", "energy drinks": "energy", "finance of healthcare": "healthcare", "retail": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["domain"] for r in discover.route_domains(df, "t").collect()} == texts


def test_cleaning(spark):
    df = spark.createDataFrame([("\n a\tb\x00c\x7fd" + "é" * 600,)], "t string")
    cleaned = df.select(discover.clean_description(F.col("t"))).first()[0]
    assert cleaned == "abcd" + "é" * 600
    assert df.select(discover.clean_description(F.col("t"), 500)).first()[0] == "abcd" + "é" * 496


def empty(spark, name):
    return spark.createDataFrame([], SCHEMAS[name])


def test_resolution_order(spark):
    specs = discover.catalog_specs(*[empty(spark, n) for n in ("domains", "datasets", "columns")])
    known = spark.createDataFrame([("bikes", [])], specs.schema).withColumn(
        "specs", F.array(*[discover._spec_literal(s) for s in discover.generic_schema("healthcare")])
    )
    requests = spark.createDataFrame(
        [(1, "e-commerce data", PLAIN), (2, " Cached One ", None), (3, "two wheels", PLAIN), (4, "cars", PLAIN.replace("bikes", "cars")), (5, "nothing", "none")],
        "id int, text string, response string",
    )
    answers = discover.answers_for_cache(spark.createDataFrame([("cached one", PLAIN)], "text string, response string"), "text", "response", "m")
    now = F.lit("2024-01-05").cast("timestamp")
    cache = cache_put(
        empty(spark, "cache"),
        answers.withColumns({"created_at": now, "expires_at": F.lit("2024-01-06").cast("timestamp")}),
    )

    def resolve(at):
        found = discover.resolve_descriptions(requests, "text", known, cache, "response", F.lit(at).cast("timestamp"))
        return {
            r["id"]: (r["source"], r["domain"], len(r["specs"] or []), len(r["answered"] or [])) for r in found.collect()
        }

    assert resolve("2024-01-05") == {
        1: ("catalog", "e-commerce", 7, 0),
        2: ("cache", "bikes", 1, 0),
        3: ("response", "bikes", 6, 1),  # the catalog's schema; the answered column is kept aside
        4: ("response", "cars", 1, 1),
        5: ("none", None, 0, 0),
    }
    assert resolve("2024-01-07")[2] == ("none", None, 0, 0)


def test_rule_table_equals_the_driver_rule(spark):
    from synthtab.functions.text_values import find_rule

    names = ["order_id", "Full Name", "capacity", "user-id", "e", "sex", "payment_x_mode", "shipping address"]
    df = spark.createDataFrame([(n,) for n in names], "column_name string")
    for strict in (False, True):
        for r in match_rules(df, strict_names=strict).collect():
            rule = find_rule(r["column_name"], strict_names=strict)
            assert r["rule"] == (rule.label if rule else None)


def test_description_values(spark):
    df = spark.createDataFrame([(1, "This is the Garden's price"), (2, "for the"), (3, "")], "id int, d string")
    found = {r[0]: r[1] for r in df.select("id", description_value(F.col("d"), Draw(row_key(df, "id"), 1, "d"))).collect()}
    assert found[1].startswith("Garden's_")
    assert found[2].startswith("Sample ") and found[3].startswith("Sample ")


@pytest.mark.parametrize("text", ["[1, 2]", "{", '{"a": ' * 50])
def test_hopeless_answers(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert discover.parse_answers(df, "t").first()["answer"] is None


def test_commentary_after_the_object(spark):
    answer = '{"domain": "d", "domain_description": "t", "columns": [{"column_name": "c", "data_type": "numeric", "description": "x"}]}'
    rows = [(1, answer + ' Note: "domain": free text'), (2, answer.replace('"d"', "5")), (3, answer + " {")]
    found = discover.parse_answers(spark.createDataFrame(rows, "id int, response string"), "response")
    assert {r["id"]: r["answer"] is not None for r in found.collect()} == {1: True, 2: False, 3: True}
