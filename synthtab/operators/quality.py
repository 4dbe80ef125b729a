"""How well a batch matches its schema: KS, null drift, rank correlation."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthtab.functions.columns import as_double, count_if, is_missing, is_numeric
from synthtab.operators import ranks
from synthtab.operators.generate import generate
from synthtab.plans.spec import ColumnSpec, as_specs, last_wins

logger = logging.getLogger(__name__)

REFERENCE_ROWS = 10_000
REFERENCE_SEED = 9999


def reference_specs(specs: Iterable[ColumnSpec | Mapping]) -> list[ColumnSpec]:
    """Numeric columns only; a column without a hint is taken as normal."""
    out = []
    for spec in last_wins(as_specs(specs)):
        if not spec.is_numeric:
            continue
        if not spec.distribution_hint:
            if spec.hint != "normal":
                logger.warning(
                    "%s: scored against a normal sample although its skewness suggests %s",
                    spec.name,
                    spec.hint,
                )
            spec = spec.with_(distribution_hint="normal")
        out.append(spec)
    return out


def reference_sample(spark: SparkSession, specs: Iterable[ColumnSpec | Mapping]) -> DataFrame:
    """The fixed-size sample a batch is compared with."""
    return generate(spark, reference_specs(specs), REFERENCE_ROWS, REFERENCE_SEED)


@lru_cache(maxsize=64)
def _collected(spark: SparkSession, specs: tuple[ColumnSpec, ...]) -> dict[str, np.ndarray]:
    # always REFERENCE_ROWS rows, so small enough for the driver
    table = generate(spark, specs, REFERENCE_ROWS, REFERENCE_SEED).toPandas()
    return {c: table[c].to_numpy(dtype=float) for c in table.columns}


def _scored(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> tuple[ColumnSpec, ...]:
    return tuple(s for s in reference_specs(specs) if s.name in df.columns and is_numeric(df, s.name))


def _ks(df: DataFrame, specs: Iterable[ColumnSpec | Mapping], group: Column | None = None) -> dict[int, dict[str, float]]:
    wanted = _scored(df, specs)
    if not wanted:
        return {}
    columns = {s.name: as_double(df, s.name) for s in wanted}
    found = ranks.ks_of_groups(df, columns, _collected(df.sparkSession, wanted), group)
    return {g: {c: round(k[c][0], 4) for c in columns if c in k and k[c][1] >= 10} for g, k in found.items()}


def ks_columns(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> dict[str, float]:
    """KS distance of each numeric column (at least 10 values) to the reference sample."""
    return _ks(df, specs).get(0, {})


Counts = dict[int, tuple[int, dict[str, int]]]


def _present(df: DataFrame, specs: list[ColumnSpec], group: Column | None = None) -> Counts:
    """Row count and non-null counts of the schema's columns for each group, in one pass."""
    wanted = [s.name for s in specs if s.name in df.columns]
    by = (F.lit(0) if group is None else group).alias("batch of rows")
    found = df.groupBy(by).agg(F.count("*"), *[count_if(~is_missing(df, c)) for c in wanted]).collect()
    return {r[0]: (r[1], {c: r[i + 2] for i, c in enumerate(wanted)}) for r in found}


def _drift(specs: list[ColumnSpec], rows: int, present: dict[str, int]) -> dict[str, float]:
    return {s.name: round(abs(1 - present[s.name] / rows - (s.null_ratio or 0.0)), 4) for s in specs if s.name in present}


def null_drift(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> dict[str, float]:
    """Distance of each column's null share from the schema's null ratio."""
    specs = last_wins(as_specs(specs))
    counts = _present(df, specs)
    return _drift(specs, *counts[0]) if counts else {}


def _correlations(df: DataFrame, specs: Iterable[ColumnSpec | Mapping], counts: Counts, group: Column | None = None) -> dict[int, float | None]:
    wanted = _scored(df, specs)
    if len(wanted) < 2 or not counts:
        return {}
    found = ranks.spearman_of_groups(df, {s.name: as_double(df, s.name) for s in wanted}, counts, group)
    expected = pd.DataFrame(_collected(df.sparkSession, wanted)).rank().corr()
    out: dict[int, float | None] = {}
    for g, pairs in found.items():
        gaps = [None if rho is None or np.isnan(expected.loc[a, b]) else abs(rho - expected.loc[a, b]) for (a, b), rho in pairs.items()]
        out[g] = None if None in gaps else round(float(2 * sum(gaps)) / len(wanted) ** 2, 4)
    return out


def correlation_difference(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> float | None:
    """Mean absolute difference of the Spearman matrices, diagonal included.

    None with fewer than two numeric columns or where a column is constant.
    """
    return _correlations(df, specs, _present(df, list(_scored(df, specs)))).get(0)


def score_batches(df: DataFrame, specs: Iterable[ColumnSpec | Mapping], group: str) -> dict[int, dict[str, float]]:
    """All metrics of each batch (the rows with one number in column ``group``) and its composite score.

    Counts, KS distances and rank correlations are each found for all batches
    at once, so the number of passes does not depend on that of batches.
    """
    specs = last_wins(as_specs(specs))
    counts = _present(df, specs, F.col(group))
    ks, correlations = _ks(df, specs, F.col(group)), _correlations(df, specs, counts, F.col(group))
    return {g: _metrics(specs, ks.get(g, {}), _drift(specs, *found), correlations.get(g)) for g, found in counts.items()}


def score_batch(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> dict[str, float]:
    """All metrics of one batch and the composite score in [0, 1]."""
    specs = last_wins(as_specs(specs))
    counts = _present(df, specs)
    if not counts:
        return _metrics(specs, {}, {}, None)
    return _metrics(specs, _ks(df, specs).get(0, {}), _drift(specs, *counts[0]), _correlations(df, specs, counts).get(0))


def _metrics(specs: list[ColumnSpec], ks: dict[str, float], drift: dict[str, float], difference: float | None) -> dict[str, float]:
    metrics: dict[str, float] = {}
    for spec in specs:
        if spec.name in ks:
            metrics[f"ks_{spec.name}"] = ks[spec.name]
        if spec.name in drift:
            metrics[f"null_drift_{spec.name}"] = drift[spec.name]
    if difference is not None:
        metrics["corr_diff"] = difference
    metrics["ks_mean"] = round(float(np.mean(list(ks.values()))), 4) if ks else 0.0
    metrics["ks_max"] = max(ks.values(), default=0.0)
    metrics["ks_count"] = len(ks)
    metrics["null_drift_mean"] = round(float(np.mean(list(drift.values()))), 4) if drift else 0.0
    metrics["quality_score"] = composite_score(metrics)
    return metrics


def composite_score(metrics: Mapping[str, float]) -> float:
    weights = {"ks_mean": 3.0, "null_drift_mean": 10.0, "corr_diff": 5.0}
    penalties = [min(w * metrics[m], 1.0) for m, w in weights.items() if metrics.get(m, 0) > 0]
    return round(max(0.0, 1.0 - float(np.mean(penalties))), 4) if penalties else 1.0


def score_frame(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> DataFrame:
    """One row: the aggregates and the score."""
    m = score_batch(df, specs)
    row = (
        m["ks_mean"], m["ks_max"], m["ks_count"], m["null_drift_mean"], m.get("corr_diff"), m["quality_score"],
    )
    return df.sparkSession.createDataFrame(
        [row],
        "ks_mean double, ks_max double, ks_count bigint, null_drift_mean double, "
        "corr_diff double, quality_score double",
    )


def column_scores(df: DataFrame, specs: Iterable[ColumnSpec | Mapping]) -> DataFrame:
    """One row per column: KS distance (numeric columns) and null drift."""
    ks, drift = ks_columns(df, specs), null_drift(df, specs)
    rows = [(c, ks.get(c), d) for c, d in drift.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, ks double, null_drift double")
