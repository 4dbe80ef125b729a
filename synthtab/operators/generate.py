"""Tables from metadata: one narrow projection over ``spark.range``."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthtab.functions import distributions as dist
from synthtab.functions.rng import Draw, row_key
from synthtab.functions.text_values import TextStream, find_rule
from synthtab.plans.spec import ColumnSpec, as_specs, last_wins

logger = logging.getLogger(__name__)

ID = "row_id"


def column_expression(
    spec: ColumnSpec,
    key: Column,
    number: Column,
    seed: int,
    sample_mean: float | None = None,
    strict_names: bool = False,
) -> Column:
    """The values of one column; ``number`` is the 1-based row number used in placeholders."""
    if spec.is_numeric:
        out = dist.numeric(spec, Draw(key, seed, spec.name), sample_mean)
        return dist.half_even(out).cast("bigint") if spec.kind == "integer" else out
    if spec.kind in ("text", "string"):
        rule = find_rule(spec.name, spec.description, strict_names)
        if rule is not None:
            return rule.make(TextStream(key, seed, spec.name))
        template = spec.template if spec.template is not None else spec.name.replace("_", " ").title()
        return F.concat(F.lit(f"{template} "), number.cast("string"))
    if spec.kind == "boolean":
        ratio = dist.value_or(spec.true_ratio, 0.5)
        return Draw(key, seed, spec.name).u1 < F.lit(ratio)
    if spec.kind == "datetime":
        return _datetime(spec, Draw(key, seed, spec.name))
    logger.warning("unknown type '%s' for %s; generating text", spec.data_type, spec.name)
    return F.concat(F.lit(f"{spec.name} "), number.cast("string"))


def _datetime(spec: ColumnSpec, draw: Draw) -> Column:
    start = datetime.fromisoformat(spec.min_date or "2020-01-01")
    end = datetime.fromisoformat(spec.max_date or "2024-12-31")
    start, end = min(start, end), max(start, end)
    span = end - start
    micros = (span.days * 86_400 + span.seconds) * 1_000_000 + span.microseconds
    offset = F.floor(draw.u1 * F.lit(float(micros))).cast("bigint")
    first = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", offset, first)


def generate_columns(
    df: DataFrame,
    specs: Iterable[ColumnSpec | Mapping],
    key: str | list[str],
    number: Column,
    seed: int = 0,
    keep: Iterable[str] = (),
    rescale: str = "analytic",
    strict_names: bool = False,
) -> DataFrame:
    """Generate the columns of ``specs`` for every row of ``df``.

    ``rescale="sample"`` divides heavy-tailed columns by their own sample mean
    (one extra aggregation pass) instead of by the mean of the distribution.
    """
    specs = last_wins(as_specs(specs))
    text = row_key(df, key)
    means = _sample_means(df, specs, text, seed) if rescale == "sample" else {}
    columns = [
        column_expression(s, text, number, seed, means.get(s.name), strict_names).alias(s.name)
        for s in specs
    ]
    return df.select(*[F.col(k) for k in keep], *columns)


def _sample_means(df: DataFrame, specs: list[ColumnSpec], key: Column, seed: int) -> dict[str, float]:
    scaled = [s for s in specs if s.is_numeric and s.hint in dist.RAW]
    if not scaled:
        return {}
    means = [F.avg(dist.RAW[s.hint](s, Draw(key, seed, s.name))) for s in scaled]
    row = df.agg(*means).first()
    return {s.name: row[i] for i, s in enumerate(scaled) if row[i] is not None}


def generate(
    spark: SparkSession,
    specs: Iterable[ColumnSpec | Mapping],
    n: int,
    seed: int = 0,
    first_row: int = 0,
    with_id: bool = False,
    rescale: str = "analytic",
    strict_names: bool = False,
) -> DataFrame:
    """``n`` rows from metadata alone.

    ``first_row`` lets batches continue the numbering; ``with_id`` keeps the
    row id, which the injectors need as their key.
    """
    ids = spark.range(first_row, first_row + n).withColumnRenamed("id", ID)
    return generate_columns(
        ids, specs, ID, F.col(ID) + 1, seed, [ID] if with_id else [], rescale, strict_names
    )
