"""Column statistics and the report tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthtab.functions.columns import TEMPORAL, as_double, col, count_if, epoch_micros, is_missing, is_numeric, kind
from synthtab.functions.distributions import half_even
from synthtab.operators import ranks
from synthtab.operators.profile import Profiler

SAMPLES = 5


def _cells(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(col, num, v): every value as text (null where missing), with a number to order by.

    One scan for all columns, however the source is stored.
    """
    entries = []
    for i, name in enumerate(df.columns if names is None else names):
        value, number = col(name), F.lit(None).cast("double")
        if is_numeric(df, name):
            number = as_double(df, name)
            if isinstance(kind(df, name), (T.FloatType, T.DoubleType)):
                value = F.when(value == 0, F.lit(0).cast(kind(df, name))).otherwise(value)  # no -0.0
        text = F.when(~is_missing(df, name), value.cast("string"))
        entries.append(F.struct(F.lit(i).alias("col"), number.alias("num"), text.alias("v")))
    return df.select(F.inline(F.array(*entries)))


def profile_columns(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column: null ratio, distinct count, moments and range, sample values.

    The samples are the smallest distinct values (rows have no order).  Two
    scans: one aggregate, and one that keeps the distinct values of all
    columns, deduplicated before the shuffle.  ``approx_distinct`` counts with
    sketches in the first scan and finds the samples by a top-k alone.
    """
    stats = []
    for i, name in enumerate(df.columns):
        missing = is_missing(df, name)
        value = as_double(df, name) if is_numeric(df, name) else F.lit(None).cast("double")
        distinct = F.approx_count_distinct(F.when(~missing, col(name))) if approx_distinct else F.lit(None)
        stats.append(
            F.struct(
                F.lit(i).alias("col"),
                F.lit(name).alias("column_name"),
                F.avg(missing.cast("double")).alias("null_ratio"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                distinct.cast("bigint").alias("approx"),
            )
        )
    moments = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    values = _cells(df).where("v IS NOT NULL").distinct()
    # row_number() <= k keeps k rows per column and task before the shuffle
    first = W.partitionBy("col").orderBy("num", "v")
    samples = (
        values.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= SAMPLES)
        .groupBy("col")
        .agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("samples"))
    )
    joined = moments.join(samples, "col", "left")
    if not approx_distinct:
        joined = joined.join(values.groupBy("col").agg(F.count("*").alias("exact")), "col", "left")
    texts = F.coalesce(F.to_json(F.transform("samples", lambda s: s["v"])), F.lit("[]"))
    return joined.select(
        "column_name",
        "null_ratio",
        F.coalesce("approx" if approx_distinct else "exact", F.lit(0)).cast("bigint").alias("distinct_count"),
        "mean",
        "std",
        "min",
        "max",
        texts.alias("sample_values"),
    )


def profile_sources(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``profile_columns`` of many tables at once, with ``source``, ``position`` and the ``rows`` of each table.

    The cells of all tables are one long table (source, column, number,
    text), so the jobs do not depend on the number of tables: one aggregate,
    and one over the distinct cells.  Tables without rows have no null ratios.
    """
    parts, names = [], []
    for at, (source, df) in enumerate(tables.items()):
        names += [(at, source, i, c) for i, c in enumerate(df.columns)]
        if df.columns:
            parts.append(_cells(df).select(F.lit(at).alias("at"), "col", "num", "v"))
    if not parts:
        raise ValueError("no table has a column")
    spark = parts[0].sparkSession
    cells = reduce(DataFrame.unionByName, parts)
    stats = cells.groupBy("at", "col").agg(
        F.count("*").alias("rows"), F.avg(F.col("v").isNull().cast("double")).alias("null_ratio"), F.avg("num").alias("mean"),
        F.stddev_samp("num").alias("std"), F.min("num").alias("min"), F.max("num").alias("max"),
    )
    values = cells.where("v IS NOT NULL").distinct()
    first = W.partitionBy("at", "col").orderBy("num", "v")
    samples = values.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLES)
    samples = samples.groupBy("at", "col").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("samples"))
    counts = values.groupBy("at", "col").agg(F.count("*").alias("exact"))
    # One row for each column of each table.
    out = spark.createDataFrame(names, "at int, source string, col int, column_name string")
    out = out.join(stats, ["at", "col"], "left").join(samples, ["at", "col"], "left").join(counts, ["at", "col"], "left")
    return out.select(
        "source", F.col("col").alias("position"), "column_name", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "null_ratio",
        F.coalesce("exact", F.lit(0)).cast("bigint").alias("distinct_count"), "mean", "std", "min", "max",
        F.coalesce(F.to_json(F.transform("samples", lambda s: s["v"])), F.lit("[]")).alias("sample_values"),
    )


def preview(df: DataFrame, order: str | list[str], rows: int = 20) -> DataFrame:
    """The first rows by the given order (a top-k, not a sort of the table)."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(rows)


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns and the overall share of nulls in percent."""
    width = len(df.columns)
    nulls = reduce(Column.__add__, [is_missing(df, c).cast("bigint") for c in df.columns])
    share = F.try_divide(F.sum(nulls) * F.lit(100.0), F.count("*") * F.lit(width))
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(width).cast("bigint").alias("columns"),
        (half_even(share * 10) / 10).alias("null_pct"),
    )


def worst_nulls(df: DataFrame, top_k: int = 5) -> DataFrame:
    """Columns with the most nulls."""
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            count_if(is_missing(df, c)).alias("nulls"),
            F.count("*").alias("rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return (
        df.agg(F.array(*entries).alias("e"))
        .select(F.inline("e"))
        .filter("nulls > 0")
        .orderBy(F.desc("nulls"), "position")
        .limit(top_k)
        .select("column_name", "nulls", (F.lit(100.0) * F.col("nulls") / F.col("rows")).alias("null_pct"))
    )


def outlier_counts(df: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Per numeric column: values outside the IQR fences and their share of all rows."""
    p = Profiler(df)
    names = [c for c in p.numeric if p.present(c) > 0]
    quartiles = p.quantiles(names, [0.25, 0.75])
    entries = []
    for c in names:
        q1, q3 = quartiles[c]
        low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        v = as_double(df, c)
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                count_if((v < F.lit(low)) | (v > F.lit(high))).alias("outliers"),
                F.count("*").alias("rows"),
            )
        )
    if not entries:
        return df.sparkSession.createDataFrame([], "column_name string, outliers bigint, outlier_pct double")
    return (
        df.agg(F.array(*entries).alias("e"))
        .select(F.inline("e"))
        .filter("outliers > 0")
        .select(
            "column_name", "outliers", (F.lit(100.0) * F.col("outliers") / F.col("rows")).alias("outlier_pct")
        )
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """Every column described: numbers and dates by moments and quartiles
    (dates as seconds since 1970), everything else by its most frequent value
    (the smallest one if several are equally frequent).  Rounded to 2 places.
    """
    measured = [c for c in df.columns if is_numeric(df, c) or isinstance(kind(df, c), TEMPORAL)]
    values = {c: _measure(df, c) for c in measured}
    extents = ranks.extents(df, values)
    quartiles = ranks.quantiles(df, values, [0.25, 0.5, 0.75], extents)
    entries = []
    for i, c in enumerate(df.columns):
        v = values.get(c, F.lit(None).cast("double"))
        q = (quartiles.get(c) or [None] * 3) if c in values else [None] * 3
        std = F.stddev_samp(v) if is_numeric(df, c) else F.lit(None).cast("double")
        numbers = [F.avg(v), std, F.min(v), *[F.lit(x).cast("double") for x in q], F.max(v)]
        titles = ["mean", "std", "min", "p25", "p50", "p75", "max"]
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                count_if(~is_missing(df, c)).alias("count"),
                *[_two_places(x).alias(t) for x, t in zip(numbers, titles)],
            )
        )
    moments = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    labels = [c for c in df.columns if c not in values]
    if not labels:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("unique", "bigint"), ("top", "string"), ("freq", "bigint"))]
        return moments.select("column_name", "count", *empty, *titles)
    counted = _cells(df, labels).where("v IS NOT NULL").groupBy("col", "v").agg(F.count("*").alias("n"))
    tops = counted.groupBy("col").agg(
        F.count("*").alias("unique"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
        F.max("n").alias("freq"),
    )
    names = F.array(*[F.lit(c) for c in labels])
    tops = tops.withColumn("column_name", F.get(names, F.col("col"))).drop("col")
    return moments.join(tops, "column_name", "left").select(
        "column_name", "count", "unique", "top", "freq", *titles
    )


def _measure(df: DataFrame, name: str) -> Column:
    if is_numeric(df, name):
        return as_double(df, name)
    return epoch_micros(df, name) / F.lit(1e6)


def _two_places(value: Column) -> Column:
    return half_even(value * 100) / 100
