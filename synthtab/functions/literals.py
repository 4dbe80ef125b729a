"""Large array literals.

``F.lit`` of a Python list makes one expression per element.  A split and
cast of a single string literal is folded by the optimizer into one array
literal instead, which keeps plans small for tables of thousands of entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double_array(values: Sequence[float]) -> Column:
    text = ",".join(repr(float(v)) for v in values)
    if not text:
        return F.array().cast("array<double>")
    return F.split(F.lit(text), ",").cast("array<double>")


def double_arrays(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[double_array(r) for r in rows])


def search_sorted(
    df: DataFrame,
    array: Column,
    longest: int,
    value: str,
    out: str,
    side: str = "left",
) -> DataFrame:
    """Add ``out``: how many entries of the sorted ``array`` lie below ``value``.

    ``side="right"`` counts entries equal to the value as well.  The search is
    unrolled into one projection per halving step, so it stays inside
    whole-stage codegen.  ``longest`` bounds the array length.
    """
    df = df.withColumn(out, F.lit(0))
    probe, position = F.col(value), F.col(out)
    step = 1 << max(longest, 1).bit_length() - 1 if longest else 0
    while step:
        entry = F.get(array, position + F.lit(step - 1))
        hit = entry < probe if side == "left" else entry <= probe
        df = df.withColumn(out, F.when(hit, position + F.lit(step)).otherwise(position))
        step >>= 1
    return df
