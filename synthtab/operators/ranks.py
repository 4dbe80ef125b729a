"""Order statistics of whole tables without a single-task sort.

``Window.orderBy`` with no partition pulls a table into one task, and the
exact ``percentile`` aggregate keeps one map entry per distinct value in one
reducer.  Here

* quantiles and exact-k cuts narrow value intervals with a few histogram
  passes, each a map-side combined count over a bounded number of buckets;
* ranks, distribution functions and gaps work on distinct values, split into
  cells by value, with running sums inside a cell and tiny per-cell offsets.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, LongType, NumericType

from synthtab.functions.literals import double_arrays, search_sorted

ROWS_PER_CELL = 200_000
MAX_CELLS = 16_384
#: Rows with one draw whose keys are compared on the driver.
TIES = 1000
#: Values with their ranks that every task may hold, to spare columns of few values the shuffles.
FEW_NUMBERS = 250_000
DIGEST_GROUPS = 256
DIGEST_ACCURACY = 10_000
LARGEST = sys.float_info.max  # stands for infinity while buckets are counted


def clean_double(col: Column) -> Column:
    """As double, with NaN turned into NULL (the one null form used here)."""
    as_double = col.cast("double")
    return F.when(~F.isnan(as_double), as_double)


@dataclass
class Extent:
    """Non-null count and range of one column."""

    count: int
    low: float | None
    high: float | None


def extents(df: DataFrame, columns: dict[str, Column]) -> dict[str, Extent]:
    if not columns:
        return {}
    aggs = []
    for col in columns.values():
        aggs += [F.count(col), F.min(col), F.max(col)]
    row = df.agg(*aggs).first()
    return {
        name: Extent(row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, name in enumerate(columns)
    }


# ---- order statistics ------------------------------------------------------


@dataclass
class _Target:
    """Ranks ``first`` and ``second`` (equal or adjacent) of one column."""

    name: str
    first: int
    second: int
    low: float
    high: float
    below: int = 0
    single: bool = False
    values: tuple[float, float] | None = None
    equal: int = 0
    full: tuple[float, float] | None = None  # the safe interval behind a guess
    by_size: bool = False  # the next pass splits by order of magnitude

    @property
    def interval(self) -> tuple[str, float, float, bool]:
        return self.name, self.low, self.high, self.by_size

    def narrow(self, under: int, counts: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        if self.full is not None:
            inside = under <= self.first and self.second < under + counts.sum()
            if not inside:
                (self.low, self.high), self.full = self.full, None
                return
            self.below, self.full = under, None
        ends = self.below + np.cumsum(counts)
        i = int(np.searchsorted(ends, self.first, side="right"))
        start, end = int(ends[i] - counts[i]), int(ends[i])
        # Equal widths that leave most values in one bucket split a long tail: magnitudes come next, and only once.
        self.by_size = not self.by_size and 2 * counts[i] > counts.sum()
        low, high = float(lows[i]), float(highs[i])
        if low == high:
            self.equal, self.below = end - start, start
        if self.second >= end:
            # ``first`` is the last of its bucket, ``second`` the first of the next
            self.values = (high, float(lows[i + 1]))
        elif low == high:
            self.values = (low, high)
        elif not self.single and self.first == start and self.second == end - 1:
            self.values = (low, high)
        elif not self.single and self.first == self.second == start:
            self.values = (low, low)
        elif not self.single and self.first == self.second == end - 1:
            self.values = (high, high)
        else:
            self.low, self.high, self.below = low, high, start


SMALLEST = math.log(5e-324)


def _magnitude(value: Column | float):
    """Monotone in the value, and linear in the logarithm of its size."""
    if isinstance(value, float):
        return math.copysign(math.log(abs(value)) - SMALLEST + 1, value) if value else 0.0
    size = F.log(F.abs(value)) - F.lit(SMALLEST) + 1
    return F.when(value == 0, 0.0).otherwise(F.when(value > 0, size).otherwise(-size))


def _bucket(value: Column, low: float, high: float, buckets: int, by_size: bool = False) -> Column:
    """Monotone bucket number of values in [low, high]; both ends differ."""
    if by_size and _magnitude(low) < _magnitude(high):
        value, low, high = _magnitude(value), _magnitude(low), _magnitude(high)
    if math.isinf(high - low):
        value, low, high = value * F.lit(0.25), low * 0.25, high * 0.25
    share = (value - F.lit(low)) / F.lit(high - low)
    # Logarithms may differ in the last bit between machines: no value of the interval falls below it.
    return F.greatest(F.floor(share * F.lit(float(buckets))).cast("int"), F.lit(0))


def _solve(df: DataFrame, columns: dict[str, Column], targets: list[_Target]) -> None:
    for t in targets:
        if t.low == t.high:
            t.values, t.equal = (t.low, t.low), -1
    while True:
        open_targets = [t for t in targets if t.values is None]
        if not open_targets:
            return
        intervals = sorted({t.interval for t in open_targets})
        buckets = max(4096, 65_536 // len(intervals))
        hist = _histograms(df, columns, intervals, buckets)
        for t in open_targets:
            t.narrow(*hist[t.interval])


def _histograms(df, columns, intervals, buckets):
    names = list(dict.fromkeys(name for name, *_ in intervals))
    # a projection of its own, so that an expensive draw is computed once a row
    values = df.select(*[columns[name].alias(f"v{j}") for j, name in enumerate(names)])
    entries = []
    for i, (name, low, high, by_size) in enumerate(intervals):
        value = F.col(f"v{names.index(name)}")
        inside = value.between(F.lit(low), F.lit(high))
        entries.append(
            F.struct(
                F.lit(i).alias("i"),
                F.when(inside, _bucket(value, low, high, buckets, by_size))
                .when(value < F.lit(low), F.lit(-1))
                .alias("b"),
                value.alias("v"),
            )
        )
    if len(entries) == 1:
        cells = values.select(entries[0].alias("e")).select("e.i", "e.b", "e.v")
    else:
        cells = values.select(F.inline(F.array(*entries)))
    # -1 counts the values below an interval; those above form one group, dropped
    table = (
        cells.groupBy("i", "b")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .toArrow()
        .to_pandas()
        .dropna(subset=["b"])
        .sort_values(["i", "b"])
    )
    out = {interval: (0, *[np.empty(0)] * 3) for interval in intervals}
    for i, g in table.groupby("i"):
        under, g = g.loc[g["b"] < 0, "n"].sum(), g[g["b"] >= 0]
        out[intervals[i]] = (int(under), g["n"].to_numpy(), g["lo"].to_numpy(), g["hi"].to_numpy())
    return out


class _QuantilePlan:
    def __init__(self, columns: dict[str, Column], probabilities: Sequence[float], known: dict[str, Extent]):
        self.names, self.columns = list(columns), dict(columns)
        self.parts: dict[str, list[tuple[_Target, float]]] = {}
        for name in self.names:
            extent = known[name]
            if extent.count and math.isinf(extent.high - extent.low):
                self.columns[name] = F.greatest(F.least(columns[name], F.lit(LARGEST)), F.lit(-LARGEST))
                extent = Extent(extent.count, max(extent.low, -LARGEST), min(extent.high, LARGEST))
            if extent.count == 0:
                continue
            self.parts[name] = []
            for p in probabilities:
                place = (extent.count - 1) * p
                first = math.floor(place)
                second = first + 1 if place > first else first
                target = _Target(name, first, second, extent.low, extent.high)
                self.parts[name].append((target, place - first))

    @property
    def targets(self) -> list[_Target]:
        return [t for parts in self.parts.values() for t, _ in parts]

    def result(self) -> dict[str, list[float] | None]:
        out: dict[str, list[float] | None] = {name: None for name in self.names}
        for name, parts in self.parts.items():
            out[name] = [_between(*t.values, share) for t, share in parts]
        return out


def _largest(known: dict[str, Extent]) -> int:
    return max((e.count for e in known.values()), default=0)


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: Sequence[float],
    known: dict[str, Extent] | None = None,
) -> dict[str, list[float] | None]:
    """Exact quantiles with linear interpolation; None for an all-null column."""
    known = extents(df, columns) if known is None else known
    plan = _QuantilePlan(columns, probabilities, known)
    _solve(df, plan.columns, plan.targets)
    return plan.result()


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation measured from the nearer end."""
    a, b = (math.copysign(math.inf, v) if abs(v) == LARGEST else v for v in (a, b))
    if a == b:
        return a
    step = b - a
    return b - step * (1 - share) if share >= 0.5 else a + step * share


@dataclass
class Choice:
    """Choose exactly ``k`` of the rows where ``draw`` is not null."""

    draw: Column
    k: int
    available: int


class _ChoicePlan:
    def __init__(self, choices: dict[str, Choice]):
        self.choices = choices
        # names of their own, as a column may have both a draw and quantiles
        self.columns = {f"draw of {name}": c.draw for name, c in choices.items()}
        self.cuts = {
            name: self._target(f"draw of {name}", c) for name, c in choices.items() if c.k < c.available
        }

    @staticmethod
    def _target(name: str, choice: Choice) -> _Target:
        # draws are uniform, so the cut lies close to k / available
        share = choice.k / choice.available
        slack = 6 * math.sqrt(max(share * (1 - share), 1 / choice.available) / choice.available)
        low, high = max(0.0, share - slack), min(1.0, share + slack)
        return _Target(name, choice.k - 1, choice.k - 1, low, high, single=True, full=(0.0, 1.0))

    def conditions(self, df: DataFrame, key: Column) -> dict[str, Column]:
        out = {}
        for name, choice in self.choices.items():
            t = self.cuts.get(name)
            if t is None:
                out[name] = choice.draw.isNotNull()
                continue
            cut = F.lit(t.values[0])
            needed = choice.k - t.below
            condition = choice.draw <= cut
            if needed < t.equal:
                last = _tie_break(df.filter(choice.draw == cut), key, needed, t.equal)
                condition = (choice.draw < cut) | ((choice.draw == cut) & (key <= F.lit(last)))
            out[name] = F.coalesce(condition, F.lit(False))
        return out


def exact_k(df: DataFrame, choices: dict[str, Choice], key: Column) -> dict[str, Column]:
    """Conditions that pick exactly the k rows with the smallest draws.

    Equal to ``row_number() over (order by draw, key) <= k``, for all choices
    in one or two counting passes.  The key must be unique.
    """
    plan = _ChoicePlan(choices)
    _solve(df, plan.columns, list(plan.cuts.values()))
    return plan.conditions(df, key)


def quantiles_and_choices(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: Sequence[float],
    known: dict[str, Extent],
    choices: dict[str, Choice],
    key: Column,
) -> tuple[dict[str, list[float] | None], dict[str, Column]]:
    """``quantiles`` and ``exact_k`` in shared passes."""
    first, second = _QuantilePlan(columns, probabilities, known), _ChoicePlan(choices)
    _solve(df, {**first.columns, **second.columns}, first.targets + list(second.cuts.values()))
    return first.result(), second.conditions(df, key)


def _tie_break(ties: DataFrame, key: Column, needed: int, equal: int) -> str:
    """The ``needed``-th smallest key of rows with one draw: two characters at a time, until few rows are left."""
    rows, known = ties.select(key.alias("k")), ""
    while equal > TIES:
        part = F.substring("k", len(known) + 1, 2)
        cells = sorted((r["c"], r["n"]) for r in rows.groupBy(part.alias("c")).agg(F.count("*").alias("n")).collect())
        for cell, count in cells:
            if needed <= count:
                break
            needed -= count
        rows, known, equal = rows.where(part == cell), known + cell, count
        if len(cell) < 2:
            break  # the keys end here, so they are all the same
    found = rows.orderBy("k").limit(needed + 1).collect() if equal <= TIES else []
    if not found or (len(found) > needed and found[needed - 1][0] == found[needed][0]):
        raise ValueError("the row key is not unique, so an exact number of rows cannot be chosen")
    return found[needed - 1][0]


# ---- value cells -----------------------------------------------------------


@dataclass
class Cells:
    """Splits each column's values into cells of similar row counts.

    ``edges`` are upper limits; ``hot`` maps values that fill whole cells to
    their approximate row counts.  Any edges give the same results, they only
    balance the work.
    """

    columns: dict[str, Column]
    edges: dict[str, list[float]]
    hot: dict[str, dict[float, int]]
    rows: int

    @property
    def longest(self) -> int:
        return max((len(e) for e in self.edges.values()), default=0)


def _cut_points(df: DataFrame, columns: list[Column], parts: int) -> list[list[float]]:
    """About ``parts - 1`` evenly spaced quantiles of each column.

    Partitions send their digests to ``DIGEST_GROUPS`` tasks, and each of
    those a bounded list of values here, so no task meets all digests.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(DIGEST_GROUPS))
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    long = df.select(group.alias("g"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    aggs = [x for i in range(len(columns)) for x in (F.count(f"c{i}"), F.percentile_approx(f"c{i}", steps, DIGEST_ACCURACY))]
    found = long.groupBy("g").agg(*aggs).collect()
    out = []
    for i in range(len(columns)):
        lists = [(r[1 + 2 * i], r[2 + 2 * i]) for r in found if r[1 + 2 * i]]
        if not lists:
            out.append([])
            continue
        values = np.concatenate([v for _, v in lists])
        weights = np.concatenate([np.full(len(v), n / len(v)) for n, v in lists])
        order = np.argsort(values, kind="stable")
        reached = np.cumsum(weights[order])
        at = np.searchsorted(reached, np.arange(1, parts) / parts * reached[-1])
        out.append(values[order][np.minimum(at, len(values) - 1)].tolist())
    return out


def value_cells(df: DataFrame, columns: dict[str, Column], rows: int) -> Cells:
    parts = min(MAX_CELLS, math.ceil(rows / ROWS_PER_CELL))
    edges: dict[str, list[float]] = {name: [] for name in columns}
    hot: dict[str, dict[float, int]] = {name: {} for name in columns}
    if parts > 1 and columns:
        for name, values in zip(columns, _cut_points(df, list(columns.values()), parts)):
            edges[name] = sorted(set(values))
            repeated = Counter(values)
            hot[name] = {v: math.ceil((k + 1) * rows / parts) for v, k in repeated.items() if k > 1}
    return Cells(columns, edges, hot, rows)


def with_cell(df: DataFrame, cells: Cells, column: str, value: str) -> DataFrame:
    """Add ``cell`` to a table whose ``column`` numbers the columns of ``cells``, group after group."""
    if cells.longest == 0:
        return df.withColumn("cell", F.lit(0))
    arrays = F.get(double_arrays(list(cells.edges.values())), F.col(column) % len(cells.edges))
    return search_sorted(df, arrays, cells.longest, value, "cell")


def _numbered(columns: list[Column], group: Column | None) -> Column:
    """``col, value`` of each column as an array; the columns of group g are numbered from g times their number on."""
    first = F.lit(0) if group is None else group.cast("int") * len(columns)
    return F.array(*(F.struct((first + i).alias("col"), c.alias("value")) for i, c in enumerate(columns)))


def value_counts(df: DataFrame, cells: Cells, flags: dict[str, Column] | None = None, group: Column | None = None) -> DataFrame:
    """(col, cell, value, n, <flags>): rows per distinct value of every column.

    ``col`` is the position of the column in ``cells`` (see ``_numbered`` for
    groups of rows); each flag is the sum of a 0/1 column.  Counts are combined
    before the shuffle, so a value that holds a third of the rows costs one row
    per task.
    """
    flags = flags or {}
    names = list(flags)
    long = df.select(
        F.inline(_numbered(list(cells.columns.values()), group)), *[flags[f].cast("int").alias(f) for f in names]
    ).filter("value IS NOT NULL")
    counted = long.groupBy("col", "value").agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f) for f in names]
    )
    return with_cell(counted, cells, "col", "value")


def in_cell_order() -> W:
    return W.partitionBy("col", "cell").orderBy("value")


def running(column: str) -> Column:
    return F.sum(column).over(in_cell_order().rowsBetween(W.unboundedPreceding, W.currentRow))


# ---- gaps ------------------------------------------------------------------


def cell_gap() -> Column:
    """Distance of a distinct value to its predecessor in the cell."""
    return F.col("value") - F.lag("value").over(in_cell_order())


# ---- Kolmogorov-Smirnov ----------------------------------------------------


def kolmogorov_p(distance: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample p-value of a KS distance."""
    x = math.sqrt(n1 * n2 / (n1 + n2)) * distance
    if x < 0.04:
        return 1.0
    terms = (2 * (-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, math.fsum(terms)))


def ks_of_groups(
    df: DataFrame, columns: dict[str, Column], samples: dict[str, np.ndarray], group: Column | None = None
) -> dict[int, dict[str, tuple[float, int]]]:
    """Exact two-sample KS distance of each column to a small fixed sample, for each group of rows in one pass.

    The largest difference of the two step functions is reached at sample
    points, so a value only matters through its position among the sorted
    distinct sample values: at most twice the sample size plus one places.
    The sample is looked up in blocks of rows, so the plan does not grow with it.
    Returns (distance, non-null count) by group (0 without one) and column;
    nothing for an empty column.
    """
    names = [n for n in columns if n in samples]
    if not names:
        return {}
    points = {n: np.unique(samples[n]) for n in names}
    shared = df.sparkSession.sparkContext.broadcast([points[n] for n in names])  # a sample has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, counts = shared.value, {}
        for batch in batches:
            columns, values = (batch.column(c).to_numpy() for c in ("col", "value"))
            for c in np.unique(columns).tolist():
                mine, step = values[columns == c], steps[c % len(steps)]
                left = np.searchsorted(step, mine)
                same = step[np.minimum(left, len(step) - 1)] == mine
                place = np.bincount(2 * left + same, minlength=2 * len(step) + 1)
                counts[c] = counts.get(c, 0) + place
        for c, found in counts.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(some), c), some, found[some])], ["col", "place", "n"])

    long = df.select(F.inline(_numbered([columns[n] for n in names], group))).filter("value IS NOT NULL")
    places = long.select("col", "value").mapInArrow(run, "col long, place long, n long")
    table = places.groupBy("col", "place").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out: dict[int, dict[str, tuple[float, int]]] = {}
    for i, found in table.groupby("col"):
        name = names[i % len(names)]
        counts = np.zeros(2 * len(points[name]) + 1)
        counts[found["place"].to_numpy()] = found["n"].to_numpy()
        total = counts.sum()
        cdf = np.cumsum(counts) / total
        ordered = np.sort(samples[name])
        reached = np.searchsorted(ordered, points[name], side="right") / len(ordered)
        before = np.concatenate([[0.0], reached[:-1]])
        at_point = np.abs(cdf[1::2] - reached)
        just_below = np.abs(cdf[0::2][:-1] - before)
        out.setdefault(i // len(names), {})[name] = (float(max(at_point.max(), just_below.max())), int(total))
    return out


def ks_against_samples(
    df: DataFrame, columns: dict[str, Column], samples: dict[str, np.ndarray]
) -> dict[str, tuple[float, int] | None]:
    """``ks_of_groups`` of the whole table; None for an empty column."""
    found = ks_of_groups(df, columns, samples).get(0, {})
    return {n: found.get(n) for n in columns if n in samples}


# ---- Spearman --------------------------------------------------------------


def spearman(
    df: DataFrame, columns: dict[str, Column], known: dict[str, int] | None = None, rows: int | None = None
) -> dict[tuple[str, str], float | None]:
    """Spearman correlation of every column pair (first name before second).

    Average ranks, pairwise complete: the ranks of a pair are taken among the
    rows where both are present.  None where a column is constant.
    ``known`` are the non-null counts and ``rows`` the table size.
    """
    if known is None or rows is None:
        counted = df.agg(F.count("*"), *[F.count(c) for c in columns.values()]).first()
        rows, known = counted[0], {n: counted[i + 1] for i, n in enumerate(columns)}
    return spearman_of_groups(df, columns, {0: (rows, known)})[0]


def spearman_of_groups(
    df: DataFrame, columns: dict[str, Column], known: dict[int, tuple[int, dict[str, int]]], group: Column | None = None
) -> dict[int, dict[tuple[str, str], float | None]]:
    """``spearman`` for each group of rows; ``known`` has the rows and non-null counts of each.

    The table is dealt out twice, whatever the number of columns and groups: by
    value, where each cell meets its rank, and back by row, where the ranks of
    a row are multiplied in blocks of rows; sums of pairs are all that leaves a
    task.  Columns of few values are not dealt out: their ranks are sent to all
    tasks, and the values travel with one other cell of their row.  Rows that
    have no other cell are multiplied where they lie.
    """
    names = list(columns)
    if len(names) < 2:
        return {g: {} for g in known}
    # Ranks among all rows, and among those where one of the columns with nulls is present.
    masks = [None, *(i for i, n in enumerate(names) if any(present[n] < rows for rows, present in known.values()))]
    rows = sum(rows for rows, _ in known.values())
    kind = df.select(F.explode(_numbered(list(columns.values()), None)).alias("e")).select("e.value").schema["value"].dataType
    columns = {n: c.cast(kind) for n, c in columns.items()}
    few = _few_values(df, columns, kind, len(masks), group)
    many = [n for n in names if n not in few]
    flags = _flags(columns, masks)
    tables = _rank_tables(df, {n: columns[n] for n in few}, flags, group)
    carried = F.array(*(columns[n].cast("double") for n in few)).cast("array<double>")
    alone = df
    for n in many:
        alone = alone.where(columns[n].isNull())
    first = F.lit(0) if group is None else group.cast("int") * max(1, len(many))
    kept = alone.select(F.monotonically_increasing_id().alias("row"), first.alias("col"), F.lit(None).cast("array<double>").alias("ranks"), carried.alias("few"))
    parts = [kept] if few else []
    if many:
        parts.append(_ranked_rows(df, {n: columns[n] for n in many}, masks, rows, group, flags, carried if few else None))
    sums = _rank_products(parts, names, many, few, tables, masks)
    out: dict[int, dict[tuple[str, str], float | None]] = {g: {} for g in known}
    for g, pairs in out.items():
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                xy, xx, yy = sums.get((g, i, j), (0.0, 0.0, 0.0))
                pairs[a, names[j]] = xy / math.sqrt(xx * yy) if xx > 0 and yy > 0 else None
    return out


def _flags(columns: dict[str, Column], masks: list[int | None]) -> dict[str, Column]:
    """For each mask, whether its column is present."""
    return {f"n{k}": list(columns.values())[m].isNotNull() if m is not None else F.lit(True) for k, m in enumerate(masks)}


def _few_values(df: DataFrame, columns: dict[str, Column], kind: DataType, masks: int, group: Column | None) -> list[str]:
    """Columns of so few values (in all groups) that every task can hold their ranks: ``FEW_NUMBERS`` numbers in all."""
    if not isinstance(kind, NumericType) or isinstance(kind, DecimalType):
        return []
    keys = [c if group is None else F.when(c.isNotNull(), F.struct(group, c)) for c in columns.values()]
    found = df.agg(*(x for c, k in zip(columns.values(), keys) for x in (F.approx_count_distinct(k), F.min(c), F.max(c)))).first()
    # Whole numbers that doubles hold exactly; NaN and infinities are values like others.
    exact = {n: not isinstance(kind, LongType) or all(v is None or abs(v) <= 2**53 for v in found[3 * i + 1 : 3 * i + 3]) for i, n in enumerate(columns)}
    sizes = {n: found[3 * i] for i, n in enumerate(columns)}
    out, held = [], 0
    for n in sorted(columns, key=lambda n: sizes[n]):
        held += sizes[n] * (1 + masks)
        if exact[n] and held <= FEW_NUMBERS:
            out.append(n)
    return [n for n in columns if n in out]


def _rank_tables(df: DataFrame, columns: dict[str, Column], flags: dict[str, Column], group: Column | None) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By group and column: the sorted values and, for each mask, their centred ranks."""
    if not columns:
        return {}
    counts = value_counts(df, Cells(columns, {n: [] for n in columns}, {}, 0), flags, group).toPandas()
    out = {}
    for col, part in counts.groupby("col"):
        part = part.sort_values("value")
        n = part[list(flags)].to_numpy(np.int64).T
        ranks = np.cumsum(n, axis=1) - (n - 1) / 2 - (n.sum(axis=1, keepdims=True) + 1) / 2
        out[divmod(int(col), len(columns))] = part["value"].to_numpy(float), np.where(n > 0, ranks, np.nan)
    return out


def _ranked_rows(
    df: DataFrame, columns: dict[str, Column], masks: list[int | None], rows: int, group: Column | None = None,
    flags: dict[str, Column] | None = None, carried: Column | None = None,
) -> DataFrame:
    """``row, col, ranks, few``: for each row its present columns with their centred ranks, one for each mask; all cells
    of a row follow each other, and one of them has what is ``carried``."""
    flags = flags or _flags(columns, masks)
    counts = value_counts(df, value_cells(df, columns, rows), flags, group)
    names = list(flags)
    # Where a cell starts follows from the totals of the cells before it: one row for each cell.
    totals = counts.groupBy("col", "cell").agg(*(F.sum(n).alias(f"t{n}") for n in names))
    ahead = W.partitionBy("col").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("col", "cell", *((F.coalesce(F.sum(f"t{n}").over(ahead), F.lit(0)) - (F.sum(f"t{n}").over(W.partitionBy("col")) + 1) / 2).alias(f"o{n}") for n in names))
    # Average rank less the mean of all ranks, so that products need no further centring.
    ranks = counts.select("col", "cell", "value", *names, *((running(n) - (F.col(n) - 1) / F.lit(2.0)).alias(f"r{n}") for n in names)).join(starts, ["col", "cell"])
    ranks = ranks.select("col", "value", F.array(*(F.when(F.col(n) > 0, F.col(f"r{n}") + F.col(f"o{n}")) for n in names)).alias("ranks"))
    first = F.coalesce(*(F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(columns.values())))
    few = F.lit(None).cast("array<double>") if carried is None else carried
    if group is not None:
        first = first + group.cast("int") * len(columns)
    long = df.select(F.monotonically_increasing_id().alias("row"), _numbered(list(columns.values()), group).alias("e"), first.alias("first"), few.alias("few"))
    long = long.select("row", "first", "few", F.inline("e")).where("value IS NOT NULL")
    long = long.select("row", "col", "value", F.when(F.col("col") == F.col("first"), F.col("few")).alias("few"))
    # A value of very many rows makes one large partition, which adaptive execution cuts.
    met = long.join(ranks.hint("merge"), ["col", "value"])
    return met.select("row", "col", "ranks", "few").repartition("row").sortWithinPartitions("row")


def _rank_products(
    parts: list[DataFrame], names: list[str], many: list[str], few: list[str], tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], masks: list[int | None]
) -> dict[tuple[int, int, int], tuple[float, float, float]]:
    """Sums of products of the centred ranks of each group's column pairs, and of their squares."""
    width = len(names)
    place = {m: k for k, m in enumerate(masks)}
    mask = [place.get(i, 0) for i in range(width)]
    at_many, at_few = np.array([names.index(n) for n in many], int), [names.index(n) for n in few]
    spark = parts[0].sparkSession
    shared = spark.sparkContext.broadcast(tables)

    def products(dense: np.ndarray) -> np.ndarray:
        # dense[mask[j], i]: ranks of column i among the rows where j is present.
        out = np.zeros((3, width, width))
        for i in range(width):
            mine, other = dense[mask, i], dense[mask[i]]
            both = ~np.isnan(other) & ~np.isnan(dense[mask[i], i])
            x, y = np.where(both, mine, 0.0), np.where(both, other, 0.0)
            out[:, i] = [np.einsum("jr,jr->j", p, q) for p, q in ((x, y), (x, x), (y, y))]
        return out

    def block(table: pa.Table, sums: dict[int, np.ndarray]) -> None:
        groups, cols = np.divmod(table["col"].to_numpy(), max(1, len(many)))
        row = table["row"].to_numpy()
        new = np.append(True, row[1:] != row[:-1])
        line, group = np.cumsum(new) - 1, groups[new]
        dense = np.full((len(masks), width, len(group)), np.nan)
        ranked = table["ranks"].is_valid().to_numpy()
        if ranked.any():
            ranks = table["ranks"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(masks))
            dense[:, at_many[cols[ranked]], line[ranked]] = ranks.T
        has = table["few"].is_valid().to_numpy()
        if few and has.any():
            values = table["few"].combine_chunks().flatten()
            present = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(few))
            values = values.to_numpy(zero_copy_only=False).reshape(-1, len(few))
            lines = line[has]
            for k, i in enumerate(at_few):
                for g in np.unique(group[lines]).tolist():
                    mine = present[:, k] & (group[lines] == g)
                    if mine.any():
                        known, ranks = shared.value[g, k]
                        dense[:, i, lines[mine]] = ranks[:, np.searchsorted(known, values[mine, k])]
        for g in np.unique(group).tolist():
            sums[g] = sums.get(g, 0.0) + products(dense[:, :, group == g])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            row = table["row"].to_numpy()
            # The last row may go on in the next batch.
            start = int(np.flatnonzero(row != row[-1])[-1]) + 1 if (row != row[-1]).any() else 0
            if start:
                block(table.slice(0, start), sums)
            held = table.slice(start)
        if held is not None:
            block(held, sums)
        i, j = np.triu_indices(width, 1)
        for g, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(i), g), i, j, *found[:, i, j])], ["g", "i", "j", "xy", "xx", "yy"])

    made = [p.mapInArrow(run, "g long, i long, j long, xy double, xx double, yy double") for p in parts]
    found = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    found = found.groupBy("g", "i", "j").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"))
    out = {(r["g"], r["i"], r["j"]): (r["xy"], r["xx"], r["yy"]) for r in found.collect()}
    shared.destroy()
    return out
