"""DuckDB SQL for the registered queries, over the whole tables."""

from __future__ import annotations

from itertools import combinations

from synthtab.functions import text_values as tv
from synthtab.functions.distributions import BETA_KNOTS, beta_quantiles, beta_shape
from synthtab.operators.generate import ID
from synthtab.plans.imperfections import DEFAULT_PROFILES, SEED_DOMAINS
from synthtab.plans.spec import ColumnSpec, generic_schema
from workloads import fixtures as fx
from workloads import queries as q

ORACLES: dict[str, str] = {}

TWO_52 = "4503599627370496::DOUBLE"


def u(key: str, seed: int, stream: str, part: int = 0, half: int = 1) -> str:
    start = 1 if half == 1 else 14
    digest = f"md5('{seed}|{stream}|{part}|' || {key})"
    return f"((('0x' || substr({digest}, {start}, 13))::BIGINT + 0.5::DOUBLE) / {TWO_52})"


def z(key: str, seed: int, stream: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({u(key, seed, stream)})) * cos(2.0::DOUBLE * pi() * {u(key, seed, stream, 0, 2)}))"


def num(value) -> str:
    return f"({float(value)!r}::DOUBLE)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def word(words: list[str], draw: str) -> str:
    items = ", ".join(text(w) for w in words)
    return f"list_extract([{items}], (1 + floor({draw} * {len(words)}))::BIGINT)"


def whole(draw: str, low: int, high: int) -> str:
    return f"({low} + floor({draw} * {float(high - low)!r}::DOUBLE)::BIGINT)"


def r6(expression: str, places: int = 6) -> str:
    return f"round({expression}, {places})"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---- generation -----------------------------------------------------------------------


def value_sql(s: ColumnSpec, key: str, number: str, seed: int, average: str | None = None) -> str:
    """The unrounded value of one column; ``average`` is SQL of a sample mean."""
    if s.is_numeric:
        out = number_sql(s, key, seed, average)
        if s.precision:
            out = stepped(out, num(s.precision))
        return f"round_even({out}, 0)::BIGINT" if s.kind == "integer" else out
    if s.kind == "boolean":
        return f"({u(key, seed, s.name)} < {num(s.true_ratio)})"
    if s.kind == "datetime":
        low, high = sorted([s.min_date or "2020-01-01", s.max_date or "2024-12-31"])
        first, last = f"epoch_us(TIMESTAMP '{low}')", f"epoch_us(TIMESTAMP '{high}')"
        return f"({first} + floor({u(key, seed, s.name)} * ({last} - {first})::DOUBLE)::BIGINT)"
    if s.kind in ("text", "string"):
        rule = tv.find_rule(s.name, s.description)
        if rule:
            return text_sql(rule.label, key, seed, s.name)
        return f"({text(s.template or s.name.replace('_', ' ').title())} || ' ' || ({number})::VARCHAR)"
    return f"({text(s.name)} || ' ' || ({number})::VARCHAR)"


def stepped(value: str, step: str) -> str:
    """Multiples of ``step``, without a negative zero."""
    multiple = f"round_even({value} / {step}, 0)"
    return f"(CASE WHEN {multiple} = 0 THEN 0.0::DOUBLE ELSE {multiple} * {step} END)"


def raw_sql(s: ColumnSpec, key: str, seed: int) -> str:
    import math

    if s.hint == "powerlaw":
        mean, std = s.mean if s.mean is not None else 1.0, max(s.std if s.std is not None else 0.5, 0.01)
        alpha = max((mean / std) ** 2, 1.5)
        return f"(pow({u(key, seed, s.name)}, {num(-1 / alpha)}) - 1 + {num(abs(s.min or 0.0) + 1)})"
    mean, std = max(s.mean, 0.01), max(s.std, 0.01)
    mu = math.log(mean**2 / math.sqrt(std**2 + mean**2))
    return f"exp({num(mu)} + {num(math.sqrt(math.log(1 + (std / mean) ** 2)))} * {z(key, seed, s.name)})"


def number_sql(s: ColumnSpec, key: str, seed: int, average: str | None) -> str:
    hint = s.hint
    low, high = (s.min if s.min is not None else 0.0), s.max
    if hint == "powerlaw":
        mean, std = s.mean if s.mean is not None else 1.0, max(s.std if s.std is not None else 0.5, 0.01)
        alpha = max((mean / std) ** 2, 1.5)
        average = average or num(1 / (alpha - 1) + abs(low) + 1)
        out = f"({raw_sql(s, key, seed)} * greatest({num(mean)} / {average}, 0.1::DOUBLE) + {num(low)})"
        return f"least(greatest({out}, {num(low)}), {num(high)})" if high is not None else out
    if hint == "lognormal":
        out = raw_sql(s, key, seed)
        if average:
            out = f"({out} * {num(max(s.mean, 0.01))} / {average})"
        if s.min is not None:
            out = f"({out} + {num(low)})"
        if high is not None:
            out = f"least(greatest({out}, {num(low)}), {num(high)})" if s.min is not None else f"least({out}, {num(high)})"
        return out
    if hint == "uniform":
        high = 1.0 if high is None else high
        high = low + 1 if high <= low else high
        return f"({num(low)} + {u(key, seed, s.name)} * {num(high - low)})"
    if hint == "left_skewed":
        table = ", ".join(repr(float(v)) for v in beta_quantiles(*beta_shape(s)))
        place = f"({u(key, seed, s.name)} * {float(BETA_KNOTS)!r}::DOUBLE)"
        knots = f"[{table}]::DOUBLE[]"
        left = f"list_extract({knots}, floor({place})::BIGINT + 1)"
        right = f"list_extract({knots}, floor({place})::BIGINT + 2)"
        unit = f"({left} + ({place} - floor({place})) * ({right} - {left}))"
        return f"({unit} * {num(high - low)} + {num(low)})"
    out = f"({num(s.mean if s.mean is not None else 0.0)} + {num(max(s.std if s.std is not None else 1.0, 0.01))} * {z(key, seed, s.name)})"
    if s.min is not None:
        out = f"greatest({out}, {num(s.min)})"
        if high is not None:
            out = f"least({out}, {num(high)})"
    return out


def text_sql(label: str, key: str, seed: int, column: str) -> str:
    stream = f"{column}:text"
    first, second = u(key, seed, stream), u(key, seed, stream, 0, 2)
    ids = {"id_trn": ("TRN", 6), "id_cust": ("CUST", 5), "id_prd": ("PRD", 4), "id_emp": ("EMP", 4), "id_ord": ("ORD", 6), "id_acc": ("ACC", 6)}
    banks = {
        "city_exact": tv.CITIES, "city": tv.CITIES, "address": tv.CITIES, "country": tv.COUNTRIES,
        "merchant": tv.MERCHANTS, "class": tv.CLASSES, "department": tv.DEPARTMENTS, "payment": tv.PAYMENTS,
        "status": tv.STATUSES, "gender": tv.GENDERS, "rating": tv.RATINGS, "yes_no": tv.YES_NO,
        "first_name": tv.FIRST_NAMES, "last_name": tv.LAST_NAMES,
    }
    if label in ids:
        prefix, digits = ids[label]
        return f"('{prefix}-' || lpad({whole(first, 1, 10**digits)}::VARCHAR, {digits}, '0'))"
    if label in banks:
        return word(banks[label], first)
    if label == "fraud":
        return f"CASE WHEN {first} < 0.95::DOUBLE THEN 'No' ELSE 'Yes' END"
    if label == "full_name":
        return f"({word(tv.FIRST_NAMES, first)} || ' ' || {word(tv.LAST_NAMES, second)})"
    if label == "email":
        domain = word(tv.MAIL_DOMAINS, u(key, seed, stream, 1))
        return f"(lower({word(tv.FIRST_NAMES, first)}) || '.' || lower({word(tv.LAST_NAMES, second)}) || '@' || {domain})"
    if label == "phone":
        return f"('+91-' || {whole(first, 70000, 99999)} || {whole(second, 10000, 99999)})"
    return f"(lower({word(tv.FIRST_NAMES, first)}) || '.com')"


def generated(specs, key: str, number: str, source: str, keep: str = "", seed: int = 42, places: int = 6) -> str:
    by_name = {s.name: s for s in specs}
    columns = [keep] if keep else []
    for s in by_name.values():
        sql = value_sql(s, key, number, seed)
        columns.append(f"{r6(sql, places) if s.kind == 'numeric' else sql} AS {s.name}")
    return f"SELECT {', '.join(columns)} FROM {source}"


def over_parts(specs) -> str:
    return generated(specs, "p_partkey", "p_partkey + 1", "part", "p_partkey")


ORACLES["gen_normal"] = over_parts(q.NORMAL)
ORACLES["gen_powerlaw"] = over_parts(q.POWERLAW)
ORACLES["gen_lognormal"] = over_parts(q.LOGNORMAL)
ORACLES["gen_uniform"] = over_parts(q.UNIFORM)
ORACLES["gen_left_skewed"] = over_parts(q.LEFT)
ORACLES["gen_bool_date"] = over_parts(q.BOOL_DATE)
ORACLES["gen_placeholders"] = (
    "SELECT p_partkey, 'Custom Note ' || (p_partkey + 1) AS custom_note, "
    "'Last wins ' || (p_partkey + 1) AS memo, 'thing ' || (p_partkey + 1) AS thing FROM part"
)
ORACLES["gen_text_ids"] = over_parts([ColumnSpec(c) for c in q.IDS])
ORACLES["gen_categories"] = over_parts([ColumnSpec(c) for c in q.CATEGORIES])
ORACLES["gen_names_emails"] = over_parts([ColumnSpec(c) for c in q.PEOPLE])
ORACLES["gen_generic_ecommerce"] = over_parts(generic_schema("e-commerce"))


def _sample_scaled() -> str:
    specs = [s.with_(name=f"{s.name}{i}") for i, s in enumerate(q.POWERLAW + q.LOGNORMAL[1:])]
    means = ", ".join(f"avg({raw_sql(s, 'p_partkey', 42)}) AS {s.name}" for s in specs)
    columns = ", ".join(
        f"{r6(value_sql(s, 'p_partkey', '0', 42, f'm.{s.name}'), 4)} AS {s.name}" for s in specs
    )
    return f"WITH m AS (SELECT {means} FROM part) SELECT p_partkey, {columns} FROM part, m"


ORACLES["gen_powerlaw_sample_scaled"] = _sample_scaled()


# ---- injection (each stage is a CTE reading the previous one) ---------------------------


def quartile_sql(value: str, source: str, p: float) -> str:
    return f"(SELECT quantile_cont({value}, {p}) FROM {source})"


def outlier_stage(source: str, columns: list[str], key: str, seed: int, patterns: dict) -> str:
    """SELECT over ``source`` with outliers in the patterned columns."""
    ranks, values = [], []
    for c in columns:
        p = patterns.get(c)
        if p is None:
            values.append(f"s.{c}")
            continue
        ranks.append(f"row_number() OVER (ORDER BY {u(key, seed, f'{c}:outlier')}, ({key})::VARCHAR) AS rn_{c}")
        k = f"greatest(1, floor((SELECT count(*) FROM {source}) * {num(p['outlier_pct'] / 100.0)})::BIGINT)"
        q1, q3 = quartile_sql(c, source, 0.25), quartile_sql(c, source, 0.75)
        far = f"({q3} - {q1}) * (3.0::DOUBLE + {u(key, seed, f'{c}:outlier-size')} * 7.0::DOUBLE)"
        high, low = f"{q3} + {far}", f"{q1} - {far}"
        side = {
            "high": high,
            "both": f"CASE WHEN {u(key, seed, f'{c}:outlier-size', 0, 2)} > 0.5 THEN {high} ELSE {low} END",
        }.get(p["direction"], low)
        values.append(f"CASE WHEN s.rn_{c} <= {k} THEN {side} ELSE s.{c} END AS {c}")
    inner = f"SELECT *, {', '.join(ranks)} FROM {source}"
    return f"SELECT {', '.join(values)} FROM ({inner}) s"


def noise_stage(source: str, columns: list[str], key: str, seed: int, patterns: dict) -> str:
    ranks, values = [], []
    for c in columns:
        p = patterns.get(c)
        if p is None or "rounding_pct" not in p:
            values.append(f"s.{c}")
            continue
        order = f"({c} IS NULL), {u(key, seed, f'{c}:noise')}, ({key})::VARCHAR"
        ranks.append(f"row_number() OVER (ORDER BY {order}) AS rn_{c}")
        present = f"(SELECT count({c}) FROM {source})"
        k = f"greatest(1, floor({present} * {num(p['rounding_pct'])} / 100)::BIGINT)"
        step = num(p.get("precision", 0.01))
        test = f"s.{c} IS NOT NULL AND s.rn_{c} <= {k}"
        values.append(f"CASE WHEN {test} THEN {stepped(f's.{c}', step)} ELSE s.{c} END AS {c}")
    inner = f"SELECT *, {', '.join(ranks)} FROM {source}" if ranks else f"SELECT * FROM {source}"
    return f"SELECT {', '.join(values)} FROM ({inner}) s"


LINE = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate))"


def mcar(value: str, key: str, seed: int, column: str, share: float) -> str:
    return f"CASE WHEN {u(key, seed, f'{column}:null')} >= {num(share)} THEN {value} END"


ORACLES["inject_mcar"] = f"""
SELECT o_orderkey, {mcar('o_totalprice', 'o_orderkey', 11, 'o_totalprice', 0.2)} AS o_totalprice,
       {mcar('o_orderstatus', 'o_orderkey', 11, 'o_orderstatus', 0.1)} AS o_orderstatus FROM orders"""

ORACLES["inject_mar"] = f"""
WITH s AS (SELECT median(l_quantity) AS med, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN {u(LINE, 12, 'l_tax:null')} >=
       least(greatest((coalesce(l_quantity, med) - lo) / greatest(hi - lo, 1) * 0.3::DOUBLE * 2, 0), 1) THEN l_tax END AS l_tax,
  {mcar('l_returnflag', LINE, 12, 'l_returnflag', 0.12)} AS l_returnflag
FROM lineitem, s"""


def _mnar(column: str, share: float) -> str:
    distance = f"abs({column}::DOUBLE - m_{column}) / greatest(s_{column}, 1e-6::DOUBLE)"
    chance = f"least({distance} / greatest(x_{column}, 1e-6::DOUBLE) * {num(share)} * 3, 1)"
    return f"CASE WHEN {u('o_orderkey', 13, f'{column}:null')} >= {chance} THEN {column}::DOUBLE END AS {column}"


ORACLES["inject_mnar"] = """
WITH a AS (SELECT avg(o_totalprice) AS m_o_totalprice, stddev_samp(o_totalprice) AS s_o_totalprice,
                  avg(o_custkey) AS m_o_custkey, stddev_samp(o_custkey) AS s_o_custkey FROM orders),
b AS (SELECT max(abs(o_totalprice - m_o_totalprice) / s_o_totalprice) AS x_o_totalprice,
             max(abs(o_custkey - m_o_custkey) / s_o_custkey) AS x_o_custkey FROM orders, a)
SELECT o_orderkey, {}, {} FROM orders, a, b""".format(_mnar("o_custkey", 0.15), _mnar("o_totalprice", 0.25))

_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_bad_columns = ["l_shipdate", *_LINE_COLUMNS, "l_extendedprice", "l_quantity", "l_discount", "l_linestatus"]
_bad = outlier_stage(
    "lineitem", _bad_columns, LINE, 14,
    {c: p for c, p in fx.PROFILES["outliers"]["outlier_patterns"].items() if c != "l_linestatus"},
)
ORACLES["inject_outliers"] = f"""
WITH bad AS ({_bad})
SELECT {', '.join(_LINE_COLUMNS)}, {', '.join(f'round({c}, 6) AS {c}' for c in ('l_extendedprice', 'l_quantity', 'l_discount'))},
       l_linestatus FROM bad"""

ORACLES["inject_noise"] = f"""
WITH o AS (SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice, o_orderpriority FROM orders),
noisy AS ({noise_stage('o', ['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderpriority'], 'o_orderkey', 15,
    {c: p for c, p in fx.PROFILES['noise']['noise_patterns'].items() if c != 'o_orderpriority'})})
SELECT o_orderkey, round(o_custkey, 6) AS o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM noisy"""

# event_type depends on value, which is nulled before it
ORACLES["apply_profile"] = f"""
WITH n1 AS (SELECT event_id, event_type, {mcar('value', 'event_id', 16, 'value', 0.08)} AS value FROM events),
s AS (SELECT median(value) AS med, min(value) AS lo, max(value) AS hi FROM n1),
n2 AS (SELECT event_id, value, CASE WHEN {u('event_id', 16, 'event_type:null')} >=
         least((coalesce(value, med) - lo) / greatest(hi - lo, 1) * 0.05::DOUBLE * 2, 1) THEN event_type END AS event_type FROM n1, s),
o AS ({outlier_stage('n2', ['event_id', 'event_type', 'value'], 'event_id', 16, fx.PROFILES['all']['outlier_patterns'])}),
x AS ({noise_stage('o', ['event_id', 'event_type', 'value'], 'event_id', 16, fx.PROFILES['all']['noise_patterns'])})
SELECT event_id, event_type, round(value, 6) AS value FROM x"""


def _dataset_like_orders() -> str:
    specs = [s for s in generic_schema("e-commerce") if s.name != "order_date"]
    profile = DEFAULT_PROFILES["e-commerce"]
    columns = [ID] + [s.name for s in specs]
    base = ", ".join(f"{value_sql(s, ID, f'{ID} + 1', 7)} AS {s.name}" for s in specs)
    nulls = ", ".join(
        f"{mcar(c, ID, 7, c, 0.15)} AS {c}" if c == "shipping_address"  # its related column is not generated
        else f"{c}::DOUBLE AS {c}" if c in ("quantity", "price") else c
        for c in columns
    )
    shown = ", ".join(f"round({c}, 6) AS {c}" if c in ("price", "quantity") else c for c in columns[1:])
    return f"""
WITH ids AS (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS {ID}),
g AS (SELECT {ID}, {base} FROM ids), n AS (SELECT {nulls} FROM g),
o AS ({outlier_stage('n', columns, ID, 7, profile['outlier_patterns'])}),
x AS ({noise_stage('o', columns, ID, 7, profile['noise_patterns'])})
SELECT {shown} FROM x"""


ORACLES["generate_dataset_like_orders"] = _dataset_like_orders()

ORACLES["batch_union"] = " UNION ALL ".join(
    f"SELECT 'Note ' || (i + 1) AS note, round({u('i', seed, 'x')}, 6) AS x "
    f"FROM (SELECT unnest(range({low}, {high})) AS i)"
    for seed, low, high in (
        (1, "0", "(SELECT count(*) FROM part)"),
        (2, "(SELECT count(*) FROM part)", "2 * (SELECT count(*) FROM part)"),
    )
)


def _batched() -> str:
    """Second attempts (seed + 1) of three batches; the wave of the first two sets the nulls of the third."""
    import random

    seeds = random.Random(5)
    tries = [seeds.randrange(2**31) + 1 for _ in range(3)]
    size = "(((SELECT count(*) FROM orders) + 2) // 3)"
    expected = num(next(s.null_ratio for s in fx.FLAT_BATCH if s.name == "fee"))
    parts = []
    for i, seed in enumerate(tries):
        # A wave is damaged as one table, with the first seed in it.
        wave, share = (tries[0], num(fx.FEE_NULLS)) if i < 2 else (tries[2], "(SELECT pct FROM p2)")
        ids = f"(SELECT unnest(range({i} * {size}, least({i + 1} * {size}, (SELECT count(*) FROM orders)))) AS i)"
        made = generated(fx.FLAT_BATCH, "i", "i + 1", ids, keep="i", seed=seed)
        parts.append(f"b{i} AS (SELECT note, price, CASE WHEN {u('i', wave, 'fee:null')} >= {share} / 100.0::DOUBLE THEN fee END AS fee FROM ({made}))")
    before = num(fx.FEE_NULLS)
    for i, old in enumerate((before, "(SELECT pct FROM p1)")):
        drift = f"(SELECT printf('%.4f', abs(1 - count(fee) / count(*)::DOUBLE - {expected}))::DOUBLE FROM b{i})"
        parts.insert(2 + i, f"p{i + 1} AS (SELECT printf('%.2f', greatest(0, {old} - {drift} * 0.1::DOUBLE * 50))::DOUBLE AS pct)")
    return f"WITH {', '.join(parts)} SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2"


ORACLES["batched_generation"] = _batched()


# ---- profiling -----------------------------------------------------------------------------

MASKED = f"""m AS (SELECT l_quantity, l_discount,
  CASE WHEN {u("concat_ws('|', l_orderkey, l_linenumber, l_partkey)", 1, 'tax')} >= 0.2 THEN l_tax END AS tax_mcar,
  CASE WHEN l_quantity <= 40 THEN l_extendedprice END AS price_mar,
  CASE WHEN l_quantity <= 45 AND l_discount <= 0.08 THEN l_extendedprice * l_tax END AS fee_mnar,
  CASE WHEN l_linenumber > 2 THEN l_shipdate END AS ship_a,
  CASE WHEN l_linenumber > 3 THEN l_returnflag END AS flag_b FROM lineitem)"""
M_COLUMNS = ["l_quantity", "l_discount", "tax_mcar", "price_mar", "fee_mnar", "ship_a", "flag_b"]
M_NUMERIC = M_COLUMNS[:5]
M_GAPS = M_COLUMNS[2:]


def null_pair_rows(source: str, columns: list[str]) -> str:
    """(rank, col_i, col_j, four ratios), the 20 most frequent pairs."""
    parts = []
    for order, (a, b) in enumerate(combinations(columns, 2)):
        parts.append(
            f"SELECT {order} AS o, '{a}' AS col_i, '{b}' AS col_j, count(*) AS n, "
            f"count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS both_, "
            f"count(*) FILTER ({a} IS NULL OR {b} IS NULL) AS either, "
            f"count(*) FILTER ({a} IS NULL) AS ni, count(*) FILTER ({b} IS NULL) AS nj FROM {source}"
        )
    return (
        "SELECT row_number() OVER (ORDER BY both_ / n DESC, o)::INTEGER AS position, col_i, col_j, "
        "both_ / n AS co_null_ratio, both_ / either AS jaccard, "
        "100.0::DOUBLE * both_ / greatest(ni, 1) AS when_i_null_j_null_pct, "
        "100.0::DOUBLE * both_ / greatest(nj, 1) AS when_j_null_i_null_pct "
        f"FROM ({union(parts)}) WHERE either > 0 ORDER BY position LIMIT 20"
    )


RATIOS = ["co_null_ratio", "jaccard", "when_i_null_j_null_pct", "when_j_null_i_null_pct"]
ORACLES["null_pairs_masked"] = (
    f"WITH {MASKED} SELECT position, col_i, col_j, {', '.join(f'round({c}, 6) AS {c}' for c in RATIOS)} "
    f"FROM ({null_pair_rows('m', M_COLUMNS)})"
)


def outlier_rows(source: str, columns: list[str], date: str | None = None) -> str:
    parts = []
    for c in columns:
        weekend = f"count(*) FILTER (isodow({date}) >= 6) / count(*)" if date else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS column_name, 100.0::DOUBLE * count(*) / any_value(nn) AS outlier_pct, "
            f"100.0::DOUBLE * count(*) FILTER (v > q3) / count(*) AS above_upper_pct, "
            f"100.0::DOUBLE * count(*) FILTER (v < q1) / count(*) AS below_lower_pct, "
            f"avg(v) AS outlier_mean, coalesce(stddev_samp(v), 0) AS outlier_std, "
            f'any_value(lo) AS "lower", any_value(hi) AS "upper", '
            f"CASE WHEN bool_or(v > q3) AND bool_or(v < q1) THEN 'both' WHEN bool_or(v > q3) THEN 'high' ELSE 'low' END AS direction, "
            f"{weekend} AS weekend_concentration "
            f"FROM (SELECT t.*, {c}::DOUBLE AS v, q1, q3, nn, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {source} t, "
            f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, count({c}) AS nn FROM {source})) "
            f"WHERE nn >= 10 AND (v < lo OR v > hi) HAVING count(*) > 0"
        )
    return union(parts)


OUTLIER_NUMBERS = ["outlier_pct", "above_upper_pct", "below_lower_pct", "outlier_mean", "outlier_std", '"lower"', '"upper"']


def shown_outliers(rows: str, weekend: bool = True, prefix: str = "") -> str:
    tail = ", round(weekend_concentration, 6) AS weekend_concentration" if weekend else ""
    numbers = ", ".join(f"round({c}, 6) AS {c}" for c in OUTLIER_NUMBERS)
    return f"{prefix} SELECT column_name, {numbers}, direction{tail} FROM ({rows})"


ORACLES["iqr_outliers_events"] = shown_outliers(outlier_rows("events", ["event_id", "user_id", "value"]), False)
ORACLES["outlier_weekend_events"] = shown_outliers(outlier_rows("events", ["event_id", "user_id", "value"], "ts"))
ORACLES["iqr_outliers_injected"] = shown_outliers(
    outlier_rows("bad", ["l_extendedprice", "l_quantity", "l_discount"], "l_shipdate"), True, f"WITH bad AS ({_bad})"
)

ORACLES["basic_stats_orders"] = union(
    [
        f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, "
        f"max({c})::DOUBLE AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM orders"
        for c in ("o_orderkey", "o_totalprice", "o_custkey")
    ]
)


def skew_rows(source: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM {source} HAVING count({c}) >= 20"
        for c in columns
    ]
    return (
        "SELECT column_name, CASE WHEN abs(skewness) < 0.3 AND abs(kurtosis) < 0.5 THEN 'normal' "
        "WHEN skewness > 1 THEN 'powerlaw' WHEN skewness > 0.5 THEN 'lognormal' "
        "WHEN skewness < -0.5 THEN 'neg_binomial' ELSE 'uniform' END AS distribution_hint, "
        f"skewness, kurtosis FROM ({union(parts)})"
    )


LINE_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
ORACLES["skew_hints_lineitem"] = (
    "SELECT column_name, distribution_hint, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis "
    f"FROM ({skew_rows('lineitem', LINE_NUMERIC)})"
)
ORACLES["distribution_choice"] = f"""
WITH {MASKED}
SELECT column_name, round(skewness, 6) AS skewness,
  CASE WHEN abs(skewness) < 0.3 THEN 'normal' WHEN skewness > 1 THEN 'powerlaw' WHEN skewness > 0.3 THEN 'lognormal'
       WHEN skewness < -0.3 THEN 'left_skewed' ELSE 'normal' END AS hint
FROM ({skew_rows('events', ['event_id', 'user_id', 'value'])} UNION ALL {skew_rows('m', M_NUMERIC)})"""


def link_rows(source: str, gaps: list[str]) -> str:
    parts = []
    for a in gaps:
        for b in gaps:
            if a != b:
                x, y = f"({a} IS NULL)::INTEGER", f"({b} IS NULL)::INTEGER"
                parts.append(f"SELECT '{a}' AS column_name, '{b}' AS other, round(corr({x}, {y}), 3) AS correlation, abs(corr({x}, {y})) AS strength FROM {source}")
    return f"SELECT column_name, other, correlation FROM ({union(parts)}) WHERE strength >= 0.3"


ORACLES["null_links_masked"] = f"WITH {MASKED} {link_rows('m', M_GAPS)}"


def shift_rows(source: str, gaps: list[str], numeric: list[str]) -> str:
    parts = []
    for m in gaps:
        for o in numeric:
            if o == m:
                continue
            parts.append(
                f"SELECT '{m}' AS column_name, '{o}' AS other, max(abs(ca / n1 - cb / n2)) AS ks, "
                f"any_value(n1)::BIGINT AS n_present, any_value(n2)::BIGINT AS n_missing "
                f"FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 "
                f"FROM (SELECT {o} AS v, count({m}) AS a, count(*) - count({m}) AS b FROM {source} WHERE {o} IS NOT NULL GROUP BY 1)) "
                f"WHERE n1 > 5 AND n2 > 5 AND (SELECT count({m}) > 10 AND count(*) - count({m}) > 5 FROM {source}) HAVING count(*) > 0"
            )
    x = "sqrt(n_present::DOUBLE * n_missing / (n_present + n_missing)) * ks"
    p = (
        f"CASE WHEN {x} < 0.04 THEN 1.0::DOUBLE ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101), "
        f"lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * ({x}) * ({x})))))) END"
    )
    return f"SELECT *, {p} AS p_value FROM ({union(parts)})"


M_SHIFTS = shift_rows("m", M_COLUMNS[2:5], M_NUMERIC)
ORACLES["value_shifts_masked"] = (
    f"WITH {MASKED} SELECT column_name, other, round(ks, 6) AS ks, n_present, n_missing, "
    f"round(p_value, 4) AS p_value FROM ({M_SHIFTS})"
)
ORACLES["ks_split_lineitem"] = (
    "WITH m AS (SELECT CASE WHEN l_returnflag <> 'R' THEN l_tax END AS kept, l_quantity, l_extendedprice FROM lineitem) "
    f"SELECT column_name, other, round(ks, 6) AS ks, n_present, n_missing FROM ({shift_rows('m', ['kept'], ['l_quantity', 'l_extendedprice'])})"
)


def missing_rows(source: str, columns: list[str], links: str, shifts: str) -> str:
    parts = [
        f"SELECT {i} AS o, '{c}' AS column_name, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_pct FROM {source} "
        f"HAVING count(*) > count({c})"
        for i, c in enumerate(columns)
    ]
    return f"""
SELECT o, column_name, null_pct, hints + linked AS links,
  CASE WHEN hints > 0 AND hints + linked >= 2 THEN 'MNAR' WHEN hints + linked >= 1 THEN 'MAR' ELSE 'MCAR' END AS pattern
FROM (SELECT o, column_name, null_pct,
    (SELECT count(*) FROM ({shifts}) s WHERE s.column_name = c.column_name AND p_value < 0.05) AS hints,
    (SELECT count(*) FROM ({links}) l WHERE l.column_name = c.column_name) AS linked
  FROM ({union(parts)}) c)"""


M_MISSING = missing_rows("m", M_GAPS, link_rows("m", M_GAPS), M_SHIFTS)
SUMMARY = "(SELECT pattern FROM (SELECT pattern, count(*) AS k, min(o) AS f FROM miss GROUP BY 1) ORDER BY k DESC, f LIMIT 1)"
ORACLES["missingness_masked"] = (
    f"WITH {MASKED}, miss AS ({M_MISSING}) "
    f"SELECT column_name, pattern, round(null_pct, 6) AS null_pct, links, {SUMMARY} AS global_summary FROM miss"
)


def noise_rows(source: str, numeric: list[str], whole_numbers: tuple[str, ...] = ()) -> str:
    parts = []
    for c in numeric:
        if c in whole_numbers:
            parts.append(f"SELECT '{c}' AS column_name, 0.0::DOUBLE AS rounding_pct, 1.0::DOUBLE AS precision FROM {source} HAVING count({c}) >= 20")
            continue
        part = f"({c} - floor({c}))"
        test = f"abs({part}) < 0.01 OR abs({part} - 0.99::DOUBLE) < 0.01 OR abs({part} - 0.5::DOUBLE) < 0.01"
        parts.append(
            f"SELECT '{c}' AS column_name, 100.0::DOUBLE * count(*) FILTER ({test}) / count({c}) AS rounding_pct, "
            f"coalesce((SELECT min(g) FROM (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL))), 0) AS precision "
            f"FROM {source} HAVING count({c}) >= 20"
        )
    return union(parts)


def shown_noise(rows: str) -> str:
    return f"SELECT column_name, round(rounding_pct, 6) AS rounding_pct, round(precision, 6) AS precision FROM ({rows})"


ORACLES["rounding_share_orders"] = shown_noise(noise_rows("orders", ["o_orderkey", "o_totalprice", "o_custkey"], ("o_orderkey", "o_custkey")))
ORACLES["min_gap_part"] = shown_noise(noise_rows("part", ["p_partkey", "p_retailprice", "p_size"], ("p_partkey", "p_size")))


def fingerprint_sql(prefix: str, source: str, columns: list[str], numeric: list[str], whole_numbers, date, missing: str) -> str:
    outliers, skew = outlier_rows(source, numeric, date), skew_rows(source, numeric)
    noise, pairs = noise_rows(source, numeric, whole_numbers), null_pair_rows(source, columns)
    none = "NULL::VARCHAR"
    parts = [
        f"SELECT 'table' AS section, '' AS subject, 'row_count' AS metric, count(*)::DOUBLE AS value, {none} AS label FROM {source}",
        f"SELECT 'table', '', 'column_count', {len(columns)}::DOUBLE, {none}",
        f"SELECT 'table', '', 'missingness', NULL, coalesce({SUMMARY}, 'no_missing')",
        f"SELECT 'missing', column_name, 'pattern', NULL, pattern FROM miss",
        f"SELECT 'missing', column_name, 'null_pct', null_pct, NULL FROM miss",
        f"SELECT 'missing', column_name, 'links', links, NULL FROM miss",
        f"SELECT 'outlier', column_name, 'direction', NULL, direction FROM ({outliers})",
        f"SELECT 'skew', column_name, 'distribution_hint', NULL, distribution_hint FROM ({skew})",
    ]
    parts += [f"SELECT 'null_pair', col_i || ',' || col_j, '{c}', {c}, NULL FROM ({pairs})" for c in RATIOS]
    numbers = OUTLIER_NUMBERS + (["weekend_concentration"] if date else [])
    parts += [f"SELECT 'outlier', column_name, {c.replace(chr(34), chr(39)) if chr(34) in c else text(c)}, {c}, NULL FROM ({outliers})" for c in numbers]
    parts += [f"SELECT 'skew', column_name, '{c}', {c}, NULL FROM ({skew})" for c in ("skewness", "kurtosis")]
    parts += [f"SELECT 'noise', column_name, '{c}', {c}, NULL FROM ({noise})" for c in ("rounding_pct", "precision")]
    return f"WITH {prefix} miss AS ({missing}) SELECT section, subject, metric, round(value, 6) AS value, label FROM ({union(parts)})"


ORACLES["fingerprint_lineitem"] = fingerprint_sql(f"{MASKED},", "m", M_COLUMNS, M_NUMERIC, (), None, M_MISSING)
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
ORACLES["fingerprint_events"] = fingerprint_sql(
    "", "events", EVENT_COLUMNS, ["event_id", "user_id", "value"], ("event_id", "user_id"), "ts",
    "SELECT 0 AS o, '' AS column_name, 0.0::DOUBLE AS null_pct, 0::BIGINT AS links, '' AS pattern WHERE false",
)


def column_profile(source: str, columns: dict[str, bool], places: int = 6) -> str:
    """``columns`` maps names to whether they are numeric."""
    parts = []
    for c, numeric in columns.items():
        stats = ", ".join(
            (f"round({f}({c}::DOUBLE), {places}) AS {n}" if numeric else f"NULL::DOUBLE AS {n}")
            for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
        )
        shown = f"to_json((SELECT list(v::VARCHAR ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)))::VARCHAR"
        parts.append(
            f"SELECT '{c}' AS column_name, round((count(*) - count({c})) / count(*), {places}) AS null_ratio, "
            f"count(DISTINCT {c}) AS distinct_count, {stats}, {shown} AS sample_values FROM {source}"
        )
    return union(parts)


ORACLES["profile_columns_orders"] = column_profile("orders", fx.SCANNED["orders"])
ORACLES["scan_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS rows, * FROM ({column_profile(t, columns)})" for t, columns in fx.SCANNED.items()
)
ORACLES["profile_columns_masked"] = f"WITH {MASKED} " + column_profile(
    "m", {c: c in M_NUMERIC for c in M_COLUMNS}, 4
)


# ---- files -------------------------------------------------------------------------------------

ORACLES["csv_round_trip"] = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'say "hi", ; ' || text
  WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text, lang, source FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@]') THEN chr(39) || text ELSE text END AS text, lang, source FROM d"""
ORACLES["csv_types_orders"] = """
SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name,
  CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') OR column_type LIKE 'DECIMAL%' THEN 'numeric' ELSE 'text' END AS data_type
FROM (DESCRIBE SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders)"""
ORACLES["folder_of_csv"] = """
SELECT o_orderkey::BIGINT AS order_key, o_custkey::BIGINT AS cust_key, printf('%08d', o_orderkey) AS code, o_totalprice AS amount, CASE WHEN o_orderkey % 3 = 0 THEN '1.50' END AS note FROM orders
UNION ALL SELECT NULL, c_custkey::BIGINT, c_name, c_acctbal, 'n/a' FROM customer"""
ORACLES["json_round_trip"] = "SELECT doc_id, text, n_chars FROM documents"
ORACLES["parquet_round_trip"] = "SELECT * FROM customer"
ORACLES["cleaned_names"] = 'SELECT c_custkey AS key, c_name AS key_2, c_nationkey AS "column", c_acctbal AS "acct bal", c_mktsegment AS price FROM customer'

# ---- reports -----------------------------------------------------------------------------------

ORACLES["preview_orders"] = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20"
_all_nulls = " + ".join(f"count(*) - count({c})" for c in M_COLUMNS)
ORACLES["table_summary"] = (
    f"WITH {MASKED} SELECT count(*) AS rows, {len(M_COLUMNS)}::BIGINT AS columns, "
    f"round_even(({_all_nulls}) * 100.0::DOUBLE / (count(*) * {len(M_COLUMNS)}) * 10, 0) / 10 AS null_pct FROM m"
)
ORACLES["worst_nulls"] = (
    f"WITH {MASKED} SELECT column_name, nulls, round(100.0::DOUBLE * nulls / n, 6) AS null_pct FROM ("
    + union([f"SELECT {i} AS o, '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS n FROM m" for i, c in enumerate(M_COLUMNS)])
    + ") WHERE nulls > 0 ORDER BY nulls DESC, o LIMIT 5"
)
ORACLES["outlier_counts_events"] = (
    "SELECT column_name, outliers, round(100.0::DOUBLE * outliers / n, 6) AS outlier_pct FROM ("
    + union(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n "
            f"FROM events, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)"
            for c in ("event_id", "user_id", "value")
        ]
    )
    + ") WHERE outliers > 0"
)


def described(source: str, columns: dict[str, str]) -> str:
    """``columns`` maps names to 'number', 'time' or 'text'."""
    parts = []
    two = "round_even(({}) * 100, 0) / 100"
    for c, kind in columns.items():
        if kind == "text":
            top = f"(SELECT {{}} FROM (SELECT {c} AS v, count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1)"
            numbers = ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
            parts.append(
                f'SELECT \'{c}\' AS column_name, count({c}) AS "count", count(DISTINCT {c}) AS "unique", '
                f"{top.format('v')} AS top, {top.format('k')} AS freq, {numbers} FROM {source}"
            )
            continue
        v = f"{c}::DOUBLE" if kind == "number" else f"(epoch_us({c}) / 1e6::DOUBLE)"
        std = two.format(f"stddev_samp({v})") if kind == "number" else "NULL::DOUBLE"
        quartiles = ", ".join(f"{two.format(f'quantile_cont({v}, {p})')} AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
        parts.append(
            f'SELECT \'{c}\' AS column_name, count({c}) AS "count", NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq, '
            f"{two.format(f'avg({v})')} AS mean, {std} AS std, {two.format(f'min({v})')} AS min, {quartiles}, {two.format(f'max({v})')} AS max FROM {source}"
        )
    return union(parts)


ORACLES["describe_customer"] = described(
    "customer", {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}
)
ORACLES["describe_events"] = described(
    "events", {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}
)


# ---- quality ---------------------------------------------------------------------------------------

MEASURED = "st AS (" + "SELECT " + ", ".join(
    f"round(avg({c}), 2) AS m_{c}, round(stddev_samp({c}), 2) AS s_{c}, min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}"
    for c in ("o_totalprice", "o_custkey")
) + " FROM orders)"
REFERENCE = "ref AS (SELECT " + ", ".join(
    f"least(greatest(m_{c} + greatest(s_{c}, 0.01) * {z('i', 9999, c)}, lo_{c}), hi_{c}) AS {c}"
    for c in ("o_totalprice", "o_custkey")
) + " FROM (SELECT unnest(range(0, 10000)) AS i), st)"
ORACLES["reference_sample_orders"] = (
    f"WITH {MEASURED}, {REFERENCE} SELECT round(o_totalprice, 4) AS o_totalprice, round(o_custkey, 4) AS o_custkey FROM ref"
)


def two_sample_ks(left: str, right: str, column: str) -> str:
    return (
        f"(SELECT max(abs(ca / na - cb / nb)) FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, "
        f"sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM ("
        f"SELECT {column}::DOUBLE AS v, 1 AS a, 0 AS b FROM {left} WHERE {column} IS NOT NULL UNION ALL "
        f"SELECT {column}::DOUBLE, 0, 1 FROM {right}) GROUP BY v)))"
    )


ORACLES["ks_quality_orders"] = f"WITH {MEASURED}, {REFERENCE} " + union(
    [
        f"SELECT '{c}' AS column_name, round({two_sample_ks('orders', 'ref', c)}, 4) AS ks, 0.0::DOUBLE AS null_drift"
        for c in ("o_totalprice", "o_custkey")
    ]
)
ORACLES["null_drift_masked"] = f"WITH {MASKED} " + union(
    [
        f"SELECT '{c}' AS column_name, round(abs((count(*) - count({c})) / count(*) - {r}::DOUBLE), 4) AS null_drift FROM m"
        for c, r in (("tax_mcar", 0.2), ("price_mar", 0.3), ("flag_b", 0.0), ("l_quantity", 0.0))
    ]
)


def rho(source: str, a: str, b: str) -> str:
    def rank(c):
        return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"

    return (
        f"(SELECT covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) FROM (SELECT {rank(a)} AS x, {rank(b)} AS y "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
    )


def rho_rows(source: str, columns: list[str]) -> str:
    return union(
        [f"SELECT '{a}' AS a, '{b}' AS b, round({rho(source, a, b)}, 6) AS rho" for a, b in combinations(columns, 2)]
    )


ORACLES["spearman_lineitem"] = rho_rows("lineitem", fx.LINEITEM_NUMERIC)
ORACLES["spearman_masked"] = f"WITH {MASKED} " + rho_rows("m", M_NUMERIC)


def _quality_generated() -> str:
    numeric = [s for s in fx.BATCH if s.is_numeric]
    batch = ", ".join(f"{value_sql(s, 'o_orderkey', 'o_orderkey + 1', 77)} AS {s.name}" for s in fx.BATCH)
    fee = u("o_orderkey", 77, "fee:null")
    ref = ", ".join(f"{value_sql(s.with_(distribution_hint=s.distribution_hint or 'normal'), 'i', 'i', 9999)} AS {s.name}" for s in numeric)
    ks = [f"round({two_sample_ks('b', 'ref', s.name)}, 4)" for s in numeric]
    drift = [f"(SELECT round(abs((count(*) - count({s.name})) / count(*) - {num(s.null_ratio or 0)}), 4) FROM b)" for s in fx.BATCH]
    diffs = [f"2 * abs({rho('b', a.name, b.name)} - {rho('ref', a.name, b.name)})" for a, b in combinations(numeric, 2)]
    return f"""
WITH g AS (SELECT {batch}, {fee} AS fee_draw FROM orders),
b AS (SELECT id, price, qty, CASE WHEN fee_draw >= 0.09::DOUBLE THEN fee END AS fee FROM g),
ref AS (SELECT {ref} FROM (SELECT unnest(range(0, 10000)) AS i)),
k AS (SELECT [{', '.join(ks)}] AS ks, [{', '.join(drift)}] AS drift,
      round(({' + '.join(diffs)}) / {len(numeric) ** 2}, 4) AS corr_diff),
a AS (SELECT round(list_avg(ks), 4) AS ks_mean, list_max(ks) AS ks_max, len(ks) AS ks_count,
      round(list_avg(drift), 4) AS null_drift_mean, corr_diff FROM k)
SELECT *, round(greatest(0, 1 - list_avg(list_filter([least(ks_mean * 3, 1), least(null_drift_mean * 10, 1), least(corr_diff * 5, 1)],
       lambda p: p > 0))), 4) AS quality_score FROM a"""


ORACLES["quality_generated"] = _quality_generated()


# ---- texts -----------------------------------------------------------------------------------------


def choose(values: list[str], number: str) -> str:
    return f"list_extract([{', '.join(text(v) for v in values)}], ({number}) % {len(values)} + 1)"


def _rule_case(loose: bool) -> str:
    tests = []
    for rule in tv.RULES:
        pattern = text("(?i)" + rule.pattern)
        subjects = ["trim(translate(lower(column_name), '_-', '  '))"]
        if loose:
            subjects.append("trim(lower(column_name))")
        subjects.append("coalesce(description, '')")
        hits = " OR ".join(f"regexp_matches({s}, {pattern})" for s in subjects)
        tests.append(f"WHEN {hits} THEN '{rule.label}'")
    return f"CASE {' '.join(tests)} END"


ORACLES["text_rule_match"] = f"""
WITH n AS (SELECT p_partkey AS id,
  CASE WHEN p_partkey % 5 = 4 THEN replace(p_name, ' ', '_') ELSE {choose(fx.NAMES, 'p_partkey')} END AS column_name,
  CASE WHEN p_partkey % 3 = 0 THEN {choose(fx.HINTS, 'p_partkey // 3')} END AS description FROM part)
SELECT id, column_name, description, {_rule_case(True)} AS rule, {_rule_case(False)} AS strict_rule FROM n"""

_stop = ", ".join(text(w) for w in tv.STOP_WORDS)
ORACLES["description_values"] = f"""
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'for the one' ELSE 'This is from ' || p_name END AS t FROM part),
w AS (SELECT p_partkey, list_extract(list_filter(regexp_extract_all(lower(t), '[\\w'']+'),
       lambda x: length(x) > 3 AND x NOT IN ({_stop})), 1) AS base FROM d)
SELECT p_partkey, CASE WHEN base IS NULL THEN {word(['Sample A', 'Sample B', 'Sample C'], u('p_partkey', 5, 'd'))}
  ELSE upper(base[1]) || base[2:] || '_' || {whole(u('p_partkey', 5, 'd', 0, 2), 1, 1000)} END AS value FROM w"""

DESCRIBED = f"des AS (SELECT p_partkey AS id, '  ' || upper(p_name) || ' ' || {choose(fx.WORDS, 'p_partkey')} || ' ' || chr(9) || 'data ' AS text FROM part)"
STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
ROUTE = "CASE " + " ".join(f"WHEN contains(lower({STRIPPED}), '{d}') THEN '{d}'" for d in SEED_DOMAINS) + " END"
ORACLES["route_descriptions"] = f"WITH {DESCRIBED} SELECT id, {ROUTE} AS domain FROM des"
ORACLES["clean_documents"] = (
    f"SELECT doc_id, regexp_replace({STRIPPED}, '[\\x00-\\x1f\\x7f]', '', 'g') AS cleaned FROM documents"
)
ORACLES["guard_formulas"] = """
WITH c AS (SELECT o_orderkey AS id, list_extract(['=', '+', '-', '@', 'a', NULL], o_orderkey % 6 + 1) || o_orderpriority AS s,
           o_orderstatus AS t, -o_totalprice AS x FROM orders)
SELECT id, CASE WHEN regexp_matches(s, '^[=+\\-@]') THEN '''' || s ELSE s END AS s, t, x FROM c"""

_VALID_FORM = "p_partkey % 6 < 4 AND p_partkey % 7 <> 0"
ORACLES["schema_from_responses"] = f"""
SELECT p_partkey AS id, 0::BIGINT AS position, 'c' || p_partkey AS column_name, 'numeric' AS data_type, 'size' AS description,
  NULL::VARCHAR AS distribution_hint, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, 0.0::DOUBLE AS min, (p_partkey + 1)::DOUBLE AS max,
  0.25::DOUBLE AS null_ratio FROM part WHERE {_VALID_FORM}
UNION ALL SELECT p_partkey, 1, 'label', 'text', 'name', NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE {_VALID_FORM}"""
ORACLES["answer_validity"] = "SELECT p_partkey AS id, (p_partkey % 6 = 0 AND p_partkey % 7 <> 0) AS valid FROM part"


# ---- catalog ---------------------------------------------------------------------------------------


def stable(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"


def hours(n: str) -> str:
    return f"(TIMESTAMP '{fx.EPOCH}' + to_hours(({n})::BIGINT))"


DOMAINS = f"dom AS (SELECT DISTINCT {stable('c_mktsegment')} AS id, c_mktsegment AS name, 'known ' || c_mktsegment AS description FROM customer)"
DATASETS = f"""ds AS (SELECT {stable("'mem://cust/' || c_custkey")} AS id, 'url' AS source, 'mem://cust/' || c_custkey AS source_url,
  {stable('c_mktsegment')} AS domain_id, c_name AS dataset_name, c_custkey + 10 AS row_count, c_custkey % 7 AS column_count,
  {hours('c_custkey % 97')} AS crawled_at FROM customer)"""


def columns_cte(name: str, step: int = 1, shift: int = 0) -> str:
    k = "o_orderkey"
    dataset = stable(f"'mem://cust/' || (o_custkey * {step})")
    return f"""{name} AS (SELECT * FROM (SELECT {dataset} AS dataset_id, 'col_' || ({k} % 9) AS column_name, '' AS column_description,
  CASE WHEN o_orderstatus = 'O' THEN 'text' ELSE 'numeric' END AS data_type,
  CASE WHEN {k} % 4 <> 0 THEN ({k} % 10) / 10.0::DOUBLE END AS null_ratio, {k} AS distinct_count,
  CASE WHEN {k} % 2 <> 0 THEN o_totalprice + {shift} END AS mean, CASE WHEN {k} % 3 <> 0 THEN o_totalprice / 2 END AS std,
  CASE WHEN {k} % 5 <> 0 THEN -o_totalprice END AS min, CASE WHEN {k} % 11 = 0 THEN o_totalprice * 2 END AS max,
  {k}::VARCHAR AS sample_values, {k}::INTEGER AS position FROM orders)
  QUALIFY row_number() OVER (PARTITION BY dataset_id, column_name ORDER BY sample_values DESC) = 1)"""


ORACLES["domain_list"] = f"WITH {DOMAINS} SELECT id, name, description FROM dom ORDER BY name"
ORACLES["domain_upsert"] = f"""
WITH {DOMAINS}, inc AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'new ' || c_mktsegment END AS name, 'd ' || c_name AS description FROM customer)
SELECT id, name, description FROM dom
UNION ALL SELECT {stable('name')}, name, min(description) FROM inc WHERE name NOT IN (SELECT name FROM dom) GROUP BY name"""
ORACLES["dataset_latest"] = f"""
WITH {DATASETS}, new AS (SELECT {stable("'mem://cust/' || (o_custkey * 2)")} AS id, 'again' AS source, 'mem://cust/' || (o_custkey * 2) AS source_url,
  {stable('o_orderpriority')} AS domain_id, 'order ' || o_orderkey AS dataset_name, o_orderkey AS row_count, o_orderkey % 5 AS column_count,
  {hours('200 + o_orderkey % 89')} AS crawled_at FROM orders),
al AS (SELECT *, 0 AS age FROM ds UNION ALL SELECT *, 1 FROM new),
latest AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY age DESC, crawled_at DESC, dataset_name DESC) = 1)
SELECT l.id, coalesce(d.source, l.source) AS source, l.source_url, l.domain_id, l.dataset_name, l.row_count, l.column_count,
  epoch_us(l.crawled_at) AS crawled_at FROM latest l LEFT JOIN ds d USING (source_url)"""
ORACLES["dataset_newest"] = f"""
WITH {DATASETS} SELECT id, source, source_url, domain_id, dataset_name, row_count, column_count, epoch_us(crawled_at) AS crawled_at
FROM (SELECT * FROM ds ORDER BY crawled_at DESC, id LIMIT 100)"""
_stat_columns = ", ".join(f"round({c}, 6) AS {c}" for c in ("null_ratio", "mean", "std", "min", "max"))
ORACLES["column_upsert"] = f"""
WITH {columns_cte('old')}, {columns_cte('new', 2, 1000)},
al AS (SELECT *, 0 AS age FROM old UNION ALL SELECT *, 1 FROM new)
SELECT dataset_id, column_name, column_description, data_type, distinct_count, sample_values, position, {_stat_columns} FROM al
QUALIFY row_number() OVER (PARTITION BY dataset_id, column_name ORDER BY age DESC) = 1"""


def first_known(column: str) -> str:
    return f"arg_min({column}, o) FILTER ({column} IS NOT NULL)"


MERGED = f"""{DOMAINS}, {DATASETS}, {columns_cte('col')},
wide AS (SELECT dom.name AS domain, col.*, row_number() OVER (ORDER BY ds.crawled_at DESC, ds.id, col.position) AS o
  FROM col JOIN ds ON col.dataset_id = ds.id JOIN dom ON ds.domain_id = dom.id),
merged AS (SELECT domain, column_name, arg_min(data_type, o) AS data_type, {', '.join(f'{first_known(c)} AS {c}' for c in ('mean', 'std', 'min', 'max', 'null_ratio'))}
  FROM wide GROUP BY 1, 2)"""
ORACLES["domain_schema_merge"] = f"WITH {MERGED} SELECT domain, column_name, data_type, {_stat_columns} FROM merged"
ORACLES["catalog_counts"] = (
    "SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer) AS domains, (SELECT count(*) FROM customer) AS datasets, "
    "(SELECT count(*) FROM orders) AS columns, (SELECT count(*) FROM region) AS profiles"
)
ORACLES["profile_upsert"] = """
WITH n AS (SELECT p_partkey * 2 AS domain_id, p_name AS profile_json FROM part)
SELECT * FROM n UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT domain_id FROM n)"""

ANSWER = """'{"domain": "' || CASE WHEN id % 2 = 0 THEN 'AUTOMOBILE' ELSE 'unknown' END || '", "domain_description": "parts", "columns": [{"column_name": "c' || id
  || '", "data_type": "numeric", "description": "size", "distribution_hint": "", "min": 0, "max": ' || (id + 1) || ', "null_ratio": ' ||
  CASE WHEN id % 7 = 0 THEN '1.5' ELSE '0.25' END || '}, {"column_name": "label", "data_type": "text", "description": "name"}]}'"""
RAW_CACHE = f"""raw AS (SELECT sha256(lower(trim(CASE WHEN id % 3 = 0 THEN {STRIPPED} || ' other' ELSE {STRIPPED} END))) AS cache_key, 'm' AS model,
  CASE WHEN id % 5 = 1 THEN '{{broken' ELSE {ANSWER} END AS response, {hours('id % 50')} AS created_at, {hours('720 + id % 50')} AS expires_at FROM des)"""
LATEST_CACHE = "QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, response DESC) = 1"
CACHE = f"{RAW_CACHE}, cache AS (SELECT * FROM raw {LATEST_CACHE})"
ORACLES["cache_write"] = f"""
WITH {DESCRIBED}, {RAW_CACHE}, al AS (SELECT * FROM raw UNION ALL
  SELECT cache_key, model, 'again ' || response, created_at + INTERVAL 10 HOUR, expires_at FROM raw)
SELECT cache_key, model, response, epoch_us(created_at) AS created_at, epoch_us(expires_at) AS expires_at FROM al {LATEST_CACHE}"""
NOW = hours(str(fx.NOW_HOURS))
ORACLES["cache_lookup"] = f"""
WITH {DESCRIBED}, {CACHE} SELECT des.id, cache.response FROM des
LEFT JOIN cache ON cache.cache_key = sha256(lower({STRIPPED})) AND cache.expires_at > {NOW}"""

ORACLES["resolve_descriptions"] = f"""
WITH {MERGED}, {DESCRIBED}, {CACHE}, known AS (SELECT domain, count(*) AS k FROM merged GROUP BY 1),
r AS (SELECT des.id, {ROUTE} AS routed, CASE WHEN cache.response IS NOT NULL AND cache.response <> '{{broken'
        AND NOT contains(cache.response, '1.5}}') THEN cache.response END AS cached,
      des.id % 6 < 4 AND des.id % 7 <> 0 AS answered
  FROM des LEFT JOIN cache ON cache.cache_key = sha256(lower({STRIPPED})) AND cache.expires_at > {NOW}),
s AS (SELECT *, CASE WHEN routed IS NOT NULL THEN 'catalog' WHEN cached IS NOT NULL THEN 'cache' WHEN answered THEN 'response' ELSE 'none' END AS source,
      CASE WHEN id % 2 = 0 THEN 'AUTOMOBILE' ELSE 'unknown' END AS said FROM r)
SELECT id, source, CASE source WHEN 'catalog' THEN routed WHEN 'cache' THEN json_extract_string(cached, '$.domain') WHEN 'response' THEN said END AS domain,
  (CASE source WHEN 'catalog' THEN coalesce(k1.k, CASE routed WHEN 'e-commerce' THEN 7 WHEN 'healthcare' THEN 6 ELSE 2 END)
     WHEN 'cache' THEN 2 WHEN 'response' THEN coalesce(k2.k, 2) ELSE 0 END)::BIGINT AS columns,
  (CASE source WHEN 'response' THEN 2 ELSE 0 END)::BIGINT AS answered_columns
FROM s LEFT JOIN known k1 ON k1.domain = routed LEFT JOIN known k2 ON k2.domain = said"""


# ---- profile tables ----------------------------------------------------------------------------------

_SECTIONS = ["null_patterns", "outlier_patterns", "skew_profiles", "noise_patterns"]


def _profile_side(side: str) -> str:
    n = "c_custkey" if side == "a" else "(p_partkey + 500)"
    pct = f"(({n}) % 40 + {0 if side == 'a' else 7})::DOUBLE"
    return f"""{side} AS (SELECT 'domain ' || ({n} // 8) AS domain, 'col ' || ({n} % 8) AS column_name, {choose(_SECTIONS, n)} AS section, {pct} AS pct
  FROM {'customer' if side == 'a' else 'part'})"""


ORACLES["profile_merge"] = f"""
WITH {_profile_side('a')}, {_profile_side('b')}
SELECT domain, column_name, section,
  CASE WHEN section = 'null_patterns' THEN CASE WHEN a.pct IS NOT NULL THEN 'MAR' ELSE 'MCAR' END END AS pattern,
  CASE WHEN section = 'outlier_patterns' THEN CASE WHEN b.pct IS NOT NULL THEN 'low' ELSE 'high' END END AS direction,
  CASE WHEN section = 'null_patterns' THEN CASE WHEN a.pct IS NOT NULL AND b.pct IS NOT NULL THEN round_even((a.pct + b.pct) * 5, 0) / 10
       ELSE coalesce(a.pct, b.pct) END END AS null_pct,
  CASE WHEN section = 'outlier_patterns' THEN CASE WHEN b.pct IS NOT NULL THEN round_even(b.pct / 8 * 10, 0) / 10 ELSE round(a.pct / 8, 4) END END AS outlier_pct,
  CASE WHEN section = 'skew_profiles' THEN coalesce(b.pct, a.pct) END AS skewness,
  CASE WHEN section = 'noise_patterns' THEN coalesce(b.pct, a.pct) END AS precision
FROM a FULL JOIN b USING (domain, column_name, section)"""
ORACLES["profile_from_json"] = """
SELECT c_name AS domain, 'c' || (c_custkey % 4) AS column_name, 'null_patterns' AS section, (c_custkey % 50)::VARCHAR AS null_pct, 'MAR' AS pattern
FROM customer WHERE c_custkey % 10 <> 3"""
