"""Imperfection fingerprints of real tables.

A :class:`Profiler` makes a fixed number of passes over the table, however
many columns it has, and each pass returns a few numbers per column (or per
column pair).  The sections below only combine those numbers.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthtab.functions.columns import (
    TEMPORAL,
    as_double,
    col,
    count_if,
    is_fractional,
    is_missing,
    kind,
    numeric_columns,
)
from synthtab.functions.literals import double_array
from synthtab.operators import ranks

MANY_PAIRS = 300
SHIFT_LEVEL = 0.05


@dataclass
class Scan:
    rows: int
    nulls: dict[str, int]
    extents: dict[str, ranks.Extent]
    mean: dict[str, float | None]
    std: dict[str, float | None]
    skew: dict[str, float | None]
    kurtosis: dict[str, float | None]
    rounding: dict[str, float | None]


@dataclass
class Fingerprint:
    domain: str
    dataset: str
    row_count: int
    column_count: int
    null_correlations: list[dict]
    outliers: dict[str, dict]
    skew_profiles: dict[str, dict]
    missingness: dict
    noise: dict[str, dict]

    def as_dict(self) -> dict:
        return dict(self.__dict__)

    def to_json(self) -> str:
        return json.dumps(self.as_dict())

    def facts(self) -> list[tuple[str, str, str, float | None, str | None]]:
        """Tidy rows (section, subject, metric, value, label)."""
        out: list = [
            ("table", "", "row_count", float(self.row_count), None),
            ("table", "", "column_count", float(self.column_count), None),
            ("table", "", "missingness", None, self.missingness["global_summary"]),
        ]
        for pair in self.null_correlations:
            subject = f"{pair['col_i']},{pair['col_j']}"
            for metric in ("co_null_ratio", "jaccard", "when_i_null_j_null_pct", "when_j_null_i_null_pct"):
                out.append(("null_pair", subject, metric, pair[metric], None))
        sections = [
            ("outlier", self.outliers),
            ("skew", self.skew_profiles),
            ("missing", self.missingness["columns"]),
            ("noise", self.noise),
        ]
        for section, columns in sections:
            for subject, info in columns.items():
                for metric, value in info.items():
                    if metric == "bounds":
                        out.append((section, subject, "lower", value["lower"], None))
                        out.append((section, subject, "upper", value["upper"], None))
                    elif metric == "correlated_with":
                        out.append((section, subject, "links", float(len(value or {})), None))
                    elif isinstance(value, str):
                        out.append((section, subject, metric, None, value))
                    else:
                        out.append((section, subject, metric, value, None))
        return out


FACTS = "section string, subject string, metric string, value double, label string"


class Profiler:
    def __init__(self, df: DataFrame):
        self.df = df
        self.columns = df.columns
        self.numeric = numeric_columns(df)

    def value(self, name: str) -> Column:
        return as_double(self.df, name)

    # ---- pass 1: counts, range, moments, rounding ---------------------------

    @cached_property
    def scan(self) -> Scan:
        aggs = [F.count("*").alias("rows")]
        aggs += [
            count_if(is_missing(self.df, c)).alias(f"null_{i}") for i, c in enumerate(self.columns)
        ]
        for i, c in enumerate(self.numeric):
            v = self.value(c)
            aggs += [
                F.min(v).alias(f"low_{i}"),
                F.max(v).alias(f"high_{i}"),
                F.avg(v).alias(f"mean_{i}"),
                F.stddev_samp(v).alias(f"std_{i}"),
                F.skewness(v).alias(f"skew_{i}"),
                F.kurtosis(v).alias(f"kurtosis_{i}"),
            ]
            if is_fractional(self.df, c):
                aggs.append(F.avg(_round_ending(v).cast("double")).alias(f"rounding_{i}"))
        row = self.df.agg(*aggs).first().asDict()
        nulls = {c: row[f"null_{i}"] for i, c in enumerate(self.columns)}
        present = {c: row["rows"] - nulls[c] for c in self.numeric}
        return Scan(
            rows=row["rows"],
            nulls=nulls,
            extents={
                c: ranks.Extent(present[c], row[f"low_{i}"], row[f"high_{i}"])
                for i, c in enumerate(self.numeric)
            },
            mean={c: row[f"mean_{i}"] for i, c in enumerate(self.numeric)},
            std={c: row[f"std_{i}"] for i, c in enumerate(self.numeric)},
            skew={
                c: unbiased_skewness(row[f"skew_{i}"], present[c]) for i, c in enumerate(self.numeric)
            },
            kurtosis={
                c: unbiased_kurtosis(row[f"kurtosis_{i}"], present[c])
                for i, c in enumerate(self.numeric)
            },
            rounding={c: row.get(f"rounding_{i}") for i, c in enumerate(self.numeric)},
        )

    def present(self, name: str) -> int:
        return self.scan.rows - self.scan.nulls[name]

    def quantiles(self, names: list[str], probabilities: list[float]) -> dict[str, list[float] | None]:
        return ranks.quantiles(
            self.df, {c: self.value(c) for c in names}, probabilities, self.scan.extents
        )

    # ---- null pairs ----------------------------------------------------------

    @cached_property
    def _gap_pairs(self) -> list[tuple[str, str]]:
        gaps = [c for c in self.columns if self.scan.nulls[c] > 0]
        return [(a, b) for i, a in enumerate(gaps) for b in gaps[i + 1 :]]

    def _pair_counts(self) -> list[Column]:
        return [
            count_if(is_missing(self.df, a) & is_missing(self.df, b)).alias(f"pair_{i}")
            for i, (a, b) in enumerate(self._gap_pairs)
        ]

    @cached_property
    def both_null(self) -> dict[tuple[str, str], int]:
        """Rows where both columns are null; pairs of columns that have nulls."""
        pairs = self._gap_pairs
        if not pairs:
            return {}
        if len(pairs) <= MANY_PAIRS:
            return dict(zip(pairs, self.df.agg(*self._pair_counts()).first()))
        return self._both_null_wide(pairs)

    def _both_null_wide(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """All pairs of a wide table in one scan: each task sums the products of its null marks."""
        gaps = list(dict.fromkeys(c for pair in pairs for c in pair))

        def products(batches):
            import numpy as np
            import pandas as pd

            total = np.zeros((len(gaps), len(gaps)))
            for marks in batches:
                block = marks.to_numpy(dtype="float64")
                total += block.T @ block
            a, b = np.nonzero(np.triu(total, 1))
            yield pd.DataFrame({"a": a, "b": b, "n": total[a, b].astype("int64")})

        marks = self.df.select(*[is_missing(self.df, c).alias(f"m{i}") for i, c in enumerate(gaps)])
        found = marks.mapInPandas(products, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        counts = dict.fromkeys(pairs, 0)
        for row in found.collect():  # at most one row per column pair
            counts[gaps[row["a"]], gaps[row["b"]]] = row["n"]
        return counts

    def both(self, a: str, b: str) -> int:
        return self.both_null.get((a, b), self.both_null.get((b, a), 0))

    def null_pairs(self, top_k: int | None = None) -> list[dict]:
        """All pairs, most frequent first, or the first ``top_k``."""
        rows, nulls = self.scan.rows, self.scan.nulls
        out = []
        for i, a in enumerate(self.columns):
            for b in self.columns[i + 1 :]:
                both = self.both(a, b)
                either = nulls[a] + nulls[b] - both
                if either == 0:
                    continue
                out.append(
                    {
                        "col_i": a,
                        "col_j": b,
                        "cols": [a, b],
                        "co_null_ratio": both / rows,
                        "jaccard": both / either,
                        "when_i_null_j_null_pct": 100.0 * both / max(nulls[a], 1),
                        "when_j_null_i_null_pct": 100.0 * both / max(nulls[b], 1),
                    }
                )
        out.sort(key=lambda pair: -pair["co_null_ratio"])
        return out[:top_k]

    # ---- outliers ------------------------------------------------------------

    def outliers(
        self, multiplier: float = 1.5, date_col: str | None = None, share_pass: bool = False
    ) -> dict[str, dict]:
        names = [c for c in self.numeric if self.present(c) >= 10]
        if not names:
            return {}
        pairs = self._gap_pairs if 0 < len(self._gap_pairs) <= MANY_PAIRS else []
        date_col = date_col or first_date_column(self.columns)
        weekend = is_weekend(self.df, date_col) if date_col else None
        quartiles = self.quantiles(names, [0.25, 0.75])
        aggs, bounds = [], {}
        for i, c in enumerate(names):
            q1, q3 = quartiles[c]
            low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
            bounds[c] = (low, high)
            v = self.value(c)
            outside = (v < F.lit(low)) | (v > F.lit(high))
            aggs += [
                count_if(outside).alias(f"k_{i}"),
                count_if(outside & (v > F.lit(q3))).alias(f"above_{i}"),
                count_if(outside & (v < F.lit(q1))).alias(f"below_{i}"),
                F.avg(F.when(outside, v)).alias(f"mean_{i}"),
                F.stddev_samp(F.when(outside, v)).alias(f"std_{i}"),
            ]
            if weekend is not None:
                aggs.append(count_if(outside & weekend).alias(f"weekend_{i}"))
        # the null pairs are counted in the same pass if somebody will ask for them
        shared = pairs and share_pass and "both_null" not in self.__dict__
        row = self.df.agg(*aggs, *(self._pair_counts() if shared else [])).first().asDict()
        if shared:
            self.both_null = {pair: row[f"pair_{i}"] for i, pair in enumerate(pairs)}
        out = {}
        for i, c in enumerate(names):
            k, above, below = row[f"k_{i}"], row[f"above_{i}"], row[f"below_{i}"]
            if k == 0:
                continue
            out[c] = {
                "outlier_pct": 100.0 * k / self.present(c),
                "above_upper_pct": 100.0 * above / k,
                "below_lower_pct": 100.0 * below / k,
                "outlier_mean": row[f"mean_{i}"],
                "outlier_std": row[f"std_{i}"] if k > 1 else 0.0,
                "bounds": {"lower": bounds[c][0], "upper": bounds[c][1]},
                "direction": "both" if above and below else ("high" if above else "low"),
            }
            if weekend is not None:
                out[c]["weekend_concentration"] = row[f"weekend_{i}"] / k
        return out

    # ---- shape ---------------------------------------------------------------

    def skew_hints(self) -> dict[str, dict]:
        out = {}
        for c in self.numeric:
            if self.present(c) < 20:
                continue
            skew, kurtosis = self.scan.skew[c], self.scan.kurtosis[c]
            out[c] = {
                "distribution_hint": shape_hint(skew, kurtosis),
                "skewness": skew,
                "kurtosis": kurtosis,
            }
        return out

    # ---- pass over distinct values: gaps and shifted distributions ------------

    @cached_property
    def _value_facts(self) -> tuple[dict[str, float], dict[tuple[str, str], tuple[float, int, int]]]:
        gap_columns = [
            c for c in self.numeric if is_fractional(self.df, c) and self.present(c) >= 20
        ]
        samples = {}
        for m in self.numeric:
            if self.present(m) <= 10 or self.scan.nulls[m] <= 5:
                continue
            for o in self.numeric:
                if o == m:
                    continue
                missing = self.scan.nulls[m] - self.both(m, o)
                present = self.present(o) - missing
                if present > 5 and missing > 5:
                    samples[m, o] = (present, missing)
        names = [c for c in self.numeric if c in gap_columns or any(o == c for _, o in samples)]
        if not names:
            return {}, {}
        masks = list(dict.fromkeys(m for m, _ in samples))
        cells = ranks.value_cells(
            self.df, {c: self.value(c) for c in names}, self.scan.rows
        )
        flags = {f"p{j}": self.value(m).isNotNull() for j, m in enumerate(masks)}
        table = ranks.value_counts(self.df, cells, flags)
        in_cell = table.withColumn("gap", ranks.cell_gap())
        aggs = [F.min("gap").alias("gap"), F.min("value").alias("low"), F.max("value").alias("high")]
        aggs.append(F.sum("n").alias("n"))
        for j, m in enumerate(masks):
            n1 = double_array([samples.get((m, o), (1, 1))[0] for o in names])
            n2 = double_array([samples.get((m, o), (1, 1))[1] for o in names])
            with_m, all_rows = ranks.running(f"p{j}"), ranks.running("n")
            step = with_m / F.get(n1, F.col("col")) - (all_rows - with_m) / F.get(n2, F.col("col"))
            in_cell = in_cell.withColumn(f"d{j}", step)
            aggs += [
                F.max(f"d{j}").alias(f"up{j}"),
                F.min(f"d{j}").alias(f"down{j}"),
                F.sum(f"p{j}").alias(f"p{j}"),
            ]
        per_cell = in_cell.groupBy("col", "cell").agg(*aggs)
        # at most MAX_CELLS rows per column from here on
        by_cell = W.partitionBy("col").orderBy("cell")
        ahead = by_cell.rowsBetween(W.unboundedPreceding, -1)
        stitched = per_cell.withColumn(
            "gap", F.least("gap", F.col("low") - F.lag("high").over(by_cell))
        )
        result = [F.coalesce(F.min("gap"), F.lit(0.0)).alias("gap")]
        for j, m in enumerate(masks):
            n1 = double_array([samples.get((m, o), (1, 1))[0] for o in names])
            n2 = double_array([samples.get((m, o), (1, 1))[1] for o in names])
            before_with = F.coalesce(F.sum(f"p{j}").over(ahead), F.lit(0))
            before_all = F.coalesce(F.sum("n").over(ahead), F.lit(0))
            start = before_with / F.get(n1, F.col("col"))
            start = start - (before_all - before_with) / F.get(n2, F.col("col"))
            stitched = stitched.withColumn(f"s{j}", start)
            highest = F.greatest(
                F.abs(F.col(f"s{j}") + F.col(f"up{j}")), F.abs(F.col(f"s{j}") + F.col(f"down{j}"))
            )
            result.append(F.max(highest).alias(f"ks{j}"))
        gaps, distances = {}, {}
        for row in stitched.groupBy("col").agg(*result).collect():
            name = names[row["col"]]
            if name in gap_columns:
                gaps[name] = row["gap"]
            for j, m in enumerate(masks):
                if (m, name) in samples:
                    distances[m, name] = (row[f"ks{j}"], *samples[m, name])
        return gaps, distances

    def null_links(self, least: float = 0.3) -> dict[tuple[str, str], float]:
        """Correlation of null indicators, from the pair counts."""
        rows, out = self.scan.rows, {}
        for a in self.columns:
            for b in self.columns:
                na, nb = self.scan.nulls[a], self.scan.nulls[b]
                if a == b or na == 0 or nb == 0:
                    continue
                spread = math.sqrt(na * (rows - na)) * math.sqrt(nb * (rows - nb))
                if spread == 0:
                    continue
                phi = (rows * self.both(a, b) - na * nb) / spread
                if abs(phi) >= least:
                    out[a, b] = round(phi, 3)
        return out

    def value_shifts(self) -> dict[tuple[str, str], tuple[float, int, int, float]]:
        """(null column, other) -> KS distance, sizes and p of other@present vs other@missing."""
        out = {}
        for (m, o), (d, n1, n2) in self._value_facts[1].items():
            out[m, o] = (d, n1, n2, ranks.kolmogorov_p(d, n1, n2))
        return out

    def missingness(self, least: float = 0.3) -> dict:
        links, shifts = self.null_links(least), self.value_shifts()
        columns = {}
        for c in self.columns:
            if self.scan.nulls[c] == 0:
                continue
            with_ = {o: r for (a, o), r in links.items() if a == c}
            hints = {
                f"{o}_mnar_hint": round(shifts[c, o][3], 4)
                for o in self.numeric
                if (c, o) in shifts and shifts[c, o][3] < SHIFT_LEVEL
            }
            with_.update(hints)
            pattern = "MNAR" if hints and len(with_) >= 2 else ("MAR" if with_ else "MCAR")
            columns[c] = {
                "pattern": pattern,
                "null_pct": 100.0 * self.scan.nulls[c] / self.scan.rows,
                "correlated_with": with_ or None,
            }
        patterns = Counter(info["pattern"] for info in columns.values())
        return {
            "columns": columns,
            "global_summary": patterns.most_common(1)[0][0] if patterns else "no_missing",
        }

    def noise(self) -> dict[str, dict]:
        out = {}
        for c in self.numeric:
            if self.present(c) < 20:
                continue
            if is_fractional(self.df, c):
                rounding, precision = 100.0 * self.scan.rounding[c], self._value_facts[0][c]
            else:
                rounding, precision = 0.0, 1.0
            out[c] = {"rounding_pct": rounding, "precision": precision}
        return out

    def fingerprint(self, domain: str = "", dataset: str = "", date_col: str | None = None) -> Fingerprint:
        outliers = self.outliers(date_col=date_col, share_pass=True)
        return Fingerprint(
            domain,
            dataset,
            self.scan.rows,
            len(self.columns),
            self.null_pairs(),
            outliers,
            self.skew_hints(),
            self.missingness(),
            self.noise(),
        )


# ---- helpers ----------------------------------------------------------------


def _round_ending(v: Column) -> Column:
    part = v - F.floor(v)
    return (F.abs(part) < 0.01) | (F.abs(part - 0.99) < 0.01) | (F.abs(part - 0.5) < 0.01)


def unbiased_skewness(g1: float | None, n: int) -> float | None:
    """Sample skewness from the population one; 0 for a constant column."""
    if n < 3:
        return 0.0
    return math.sqrt(n * (n - 1)) / (n - 2) * g1 if g1 is not None else 0.0


def unbiased_kurtosis(g2: float | None, n: int) -> float | None:
    if n < 4:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if g2 is not None else 0.0


def shape_hint(skew: float, kurtosis: float) -> str:
    if abs(skew) < 0.3 and abs(kurtosis) < 0.5:
        return "normal"
    if skew > 1.0:
        return "powerlaw"
    if skew > 0.5:
        return "lognormal"
    return "neg_binomial" if skew < -0.5 else "uniform"


def first_date_column(columns: list[str]) -> str | None:
    return next((c for c in columns if "date" in c.lower() or "time" in c.lower()), None)


def is_weekend(df: DataFrame, name: str) -> Column:
    """Saturday or Sunday; unparseable dates are not."""
    value, type_ = col(name), kind(df, name)
    if isinstance(type_, TEMPORAL):
        when = value
    elif isinstance(type_, T.StringType):
        when = F.try_to_timestamp(value)
    elif name in numeric_columns(df):  # nanoseconds since 1970
        when = F.timestamp_micros(F.floor(value / F.lit(1000.0)).cast("bigint"))
    else:
        return F.lit(False)
    return F.coalesce(F.weekday(when) >= 5, F.lit(False))


# ---- operators ----------------------------------------------------------------


def null_pairs(df: DataFrame, top_k: int = 20) -> DataFrame:
    """Column pairs that are null together, most frequent first."""
    fields = "co_null_ratio double, jaccard double, when_i_null_j_null_pct double, when_j_null_i_null_pct double"
    names = ["position", "col_i", "col_j", *[f.split()[0] for f in fields.split(", ")]]
    found = Profiler(df).null_pairs(top_k)
    rows = [(i + 1, *[pair[n] for n in names[1:]]) for i, pair in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, f"position int, col_i string, col_j string, {fields}")


def iqr_outliers(df: DataFrame, multiplier: float = 1.5, date_col: str | None = None) -> DataFrame:
    """One row per numeric column that has values strictly outside the IQR fences."""
    found = Profiler(df).outliers(multiplier, date_col)
    rows = [
        (
            c,
            info["outlier_pct"],
            info["above_upper_pct"],
            info["below_lower_pct"],
            info["outlier_mean"],
            info["outlier_std"],
            info["bounds"]["lower"],
            info["bounds"]["upper"],
            info["direction"],
            info.get("weekend_concentration"),
        )
        for c, info in found.items()
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, outlier_pct double, above_upper_pct double, below_lower_pct double, "
        "outlier_mean double, outlier_std double, lower double, upper double, direction string, "
        "weekend_concentration double",
    )


def skew_hints(df: DataFrame) -> DataFrame:
    rows = [(c, *info.values()) for c, info in Profiler(df).skew_hints().items()]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, distribution_hint string, skewness double, kurtosis double"
    )


def basic_stats(df: DataFrame) -> DataFrame:
    """Moments and quartiles of every numeric column, nulls dropped."""
    p = Profiler(df)
    names = [c for c in p.numeric if p.present(c) > 0]
    quartiles = p.quantiles(names, [0.25, 0.5, 0.75])
    rows = [
        (
            c,
            p.scan.mean[c],
            p.scan.std[c] if p.present(c) > 1 else None,
            p.scan.extents[c].low,
            *quartiles[c],
            p.scan.extents[c].high,
            p.scan.skew[c],
            p.scan.kurtosis[c],
        )
        for c in names
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, mean double, std double, min double, q25 double, q50 double, "
        "q75 double, max double, skew double, kurtosis double",
    )


def null_links(df: DataFrame, least: float = 0.3) -> DataFrame:
    rows = [(a, b, r) for (a, b), r in Profiler(df).null_links(least).items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, other string, correlation double")


def value_shifts(df: DataFrame) -> DataFrame:
    """Two-sample KS of every numeric column, split by another column's nulls."""
    rows = [(m, o, *values) for (m, o), values in Profiler(df).value_shifts().items()]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, other string, ks double, n_present bigint, n_missing bigint, p_value double",
    )


def missingness(df: DataFrame, least: float = 0.3) -> DataFrame:
    found = Profiler(df).missingness(least)
    rows = [
        (c, info["pattern"], info["null_pct"], info["correlated_with"], found["global_summary"])
        for c, info in found["columns"].items()
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, pattern string, null_pct double, "
        "correlated_with map<string,double>, global_summary string",
    )


def noise(df: DataFrame) -> DataFrame:
    rows = [(c, info["rounding_pct"], info["precision"]) for c, info in Profiler(df).noise().items()]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, rounding_pct double, precision double"
    )


def fingerprint(
    df: DataFrame, domain: str = "", dataset: str = "", date_col: str | None = None
) -> Fingerprint:
    """All sections, sharing their passes."""
    return Profiler(df).fingerprint(domain, dataset, date_col)


def fingerprint_frame(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """The fingerprint as tidy rows."""
    return df.sparkSession.createDataFrame(fingerprint(df, date_col=date_col).facts(), FACTS)
