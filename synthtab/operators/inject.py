"""Imperfections for any DataFrame: nulls, outliers, rounding noise.

Every operator maps a DataFrame to a DataFrame by column expressions.  Draws
depend on the row key alone, so a task that is retried makes the same rows.
The statistics the expressions need (medians, quartiles, exact-k cuts) are
found beforehand in a few passes shared by all columns.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthtab.functions.columns import as_double, col, is_integral, is_numeric, kind
from synthtab.functions.distributions import SAMPLERS, to_step
from synthtab.functions.rng import Draw, row_key
from synthtab.operators import ranks

logger = logging.getLogger(__name__)

Key = str | Iterable[str]


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns(changes) if changes else df


def _check_key(patterns: Mapping, key: Key) -> None:
    names = {key} if isinstance(key, str) else set(key)
    changed = names.intersection(patterns)
    if changed:
        raise ValueError(f"key columns cannot be changed: {', '.join(sorted(changed))}")


def _draw(df: DataFrame, key: Key, seed: int, stream: str) -> Draw:
    return Draw(row_key(df, key), seed, stream)


def _as_doubles(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return _replace(df, {c: col(c).cast("double") for c in names if is_integral(df, c)})


# ---- nulls -------------------------------------------------------------------


def inject_nulls(df: DataFrame, profile: Mapping, key: Key, seed: int = 0) -> DataFrame:
    """Nulls by the profile's ``null_patterns``: MCAR, MAR or MNAR per column.

    Columns are handled in profile order and each sees the earlier changes.
    Columns whose statistics do not depend on a changed column share a pass.
    """
    patterns = {
        c: p
        for c, p in profile.get("null_patterns", {}).items()
        if c in df.columns and not isinstance(kind(df, c), (T.BooleanType, T.BinaryType))
    }
    _check_key(patterns, key)
    df = _as_doubles(df, patterns)  # even where null_pct is 0
    related = {c: _related(c, p, profile, df) for c, p in patterns.items()}
    wave: list[str] = []
    for c, p in patterns.items():
        if p.get("null_pct", 0) <= 0:
            continue
        if related[c] in wave:
            df = _null_wave(df, wave, patterns, related, key, seed)
            wave = []
        wave.append(c)
    return _null_wave(df, wave, patterns, related, key, seed)


def _related(column: str, pattern: Mapping, profile: Mapping, df: DataFrame) -> str | None:
    """The numeric column an MAR column depends on, if any."""
    if pattern.get("pattern", "MCAR") != "MAR":
        return None
    for entry in profile.get("null_correlations", []):
        names = entry.get("cols", [])
        if column in names and len(names) >= 2:
            other = next((n for n in names if n != column), None)
            return other if other in df.columns and is_numeric(df, other) else None
    return None


def _null_wave(df, wave, patterns, related, key, seed) -> DataFrame:
    if not wave:
        return df
    own = [c for c in wave if patterns[c].get("pattern") == "MNAR" and is_numeric(df, c)]
    others = [related[c] for c in wave if related[c]]
    watched = {c: as_double(df, c) for c in dict.fromkeys([*own, *others])}
    known = ranks.extents(df, watched)
    medians = {c: m and m[0] for c, m in ranks.quantiles(df, watched, [0.5], known).items()}
    spread = _filled_moments(df, own, watched, medians)
    changes = {}
    for c in wave:
        share = patterns[c]["null_pct"] / 100.0
        if c in own:
            chance = _own_chance(watched[c], share, medians[c], known[c], spread.get(c))
        elif related[c]:
            other = related[c]
            chance = _other_chance(watched[other], share, medians[other], known[other])
        else:
            chance = F.lit(share)
        keep = _draw(df, key, seed, f"{c}:null").u1 >= chance
        changes[c] = F.when(keep, col(c))
    return _replace(df, changes)


def _filled_moments(df, names, values, medians) -> dict[str, tuple[float, float]]:
    """Mean and deviation after nulls are filled with the median."""
    names = [c for c in names if medians[c] is not None]
    if not names:
        return {}
    aggs = []
    for c in names:
        filled = F.coalesce(values[c], F.lit(medians[c]))
        aggs += [F.avg(filled), F.stddev_samp(filled)]
    row = df.agg(*aggs).first()
    return {c: (row[2 * i], row[2 * i + 1] or 0.0) for i, c in enumerate(names)}


def _own_chance(value, share, median, extent, moments) -> Column:
    """MNAR: the further from the mean, the likelier to be null."""
    if moments is None:
        return F.lit(0.0)
    mean, std = moments[0], max(moments[1], 1e-6)
    # the median lies between the extremes, so they give the largest distance
    furthest = max(max(abs(extent.low - mean), abs(extent.high - mean)) / std, 1e-6)
    z = F.abs((F.coalesce(value, F.lit(median)) - F.lit(mean)) / F.lit(std))
    return F.least(z / F.lit(furthest) * F.lit(share) * F.lit(3.0), F.lit(1.0))


def _other_chance(value, share, median, extent) -> Column:
    """MAR: the higher the related column, the likelier to be null."""
    if median is None:
        return F.lit(0.0)
    width = max(extent.high - extent.low, 1.0)
    place = (F.coalesce(value, F.lit(median)) - F.lit(extent.low)) / F.lit(width)
    return F.least(place * F.lit(share) * F.lit(2.0), F.lit(1.0))


# ---- outliers ------------------------------------------------------------------


def inject_outliers(df: DataFrame, profile: Mapping, key: Key, seed: int = 0) -> DataFrame:
    """Exactly ``int(rows * pct)`` outliers (at least one) per profiled column."""
    patterns = _numeric_patterns(df, profile.get("outlier_patterns", {}))
    _check_key(patterns, key)
    df = _as_doubles(df, patterns)
    patterns = {c: p for c, p in patterns.items() if p.get("outlier_pct", 0) > 0}
    if not patterns:
        return df
    values = {c: as_double(df, c) for c in patterns}
    known, rows = _extents_and_rows(df, values)
    values = {c: v for c, v in values.items() if known[c].count >= 5}
    if not values:
        return df
    choices, sizes = {}, {}
    for c in values:
        k = max(1, int(rows * (patterns[c]["outlier_pct"] / 100.0)))
        choices[c] = ranks.Choice(_draw(df, key, seed, f"{c}:outlier").u1, k, rows)
        sizes[c] = _draw(df, key, seed, f"{c}:outlier-size")
    quartiles, chosen = ranks.quantiles_and_choices(
        df, values, [0.25, 0.75], known, choices, row_key(df, key)
    )
    changes = {}
    for c in values:
        q1, q3 = quartiles[c]
        far = F.lit(q3 - q1) * (F.lit(3.0) + sizes[c].u1 * F.lit(7.0))
        direction = patterns[c].get("direction", "both")
        high, low = F.lit(q3) + far, F.lit(q1) - far
        if direction == "both":
            outlier = F.when(sizes[c].u2 > 0.5, high).otherwise(low)
        else:
            outlier = high if direction == "high" else low
        changes[c] = F.when(chosen[c], outlier).otherwise(col(c))
    return _replace(df, changes)


def _numeric_patterns(df: DataFrame, patterns: Mapping) -> dict[str, Mapping]:
    return {c: p for c, p in patterns.items() if c in df.columns and is_numeric(df, c)}


def _extents_and_rows(df, values) -> tuple[dict[str, ranks.Extent], int]:
    known = ranks.extents(df, {**values, " rows": F.lit(1)})
    return known, known[" rows"].count


# ---- rounding noise --------------------------------------------------------------


def inject_noise(df: DataFrame, profile: Mapping, key: Key, seed: int = 0) -> DataFrame:
    """Round exactly ``int(present * pct)`` present values (at least one) per column."""
    patterns = _numeric_patterns(df, profile.get("noise_patterns", {}))
    _check_key(patterns, key)
    df = _as_doubles(df, patterns)
    patterns = {
        c: p
        for c, p in patterns.items()
        if p.get("rounding_pct", 0) > 0 and p.get("precision", 0.01) > 0
    }
    if not patterns:
        return df
    counted = df.agg(*[F.count(as_double(df, c)) for c in patterns]).first()
    choices = {}
    for c, present in zip(patterns, counted):
        if present:
            k = max(1, int(present * patterns[c]["rounding_pct"] / 100))
            draw = F.when(as_double(df, c).isNotNull(), _draw(df, key, seed, f"{c}:noise").u1)
            choices[c] = ranks.Choice(draw, k, present)
    if not choices:
        return df
    chosen = ranks.exact_k(df, choices, row_key(df, key))
    changes = {
        c: F.when(chosen[c], to_step(col(c), patterns[c].get("precision", 0.01))).otherwise(col(c))
        for c in choices
    }
    return _replace(df, changes)


# ---- skew (opt-in) -----------------------------------------------------------------


def apply_skew(df: DataFrame, profile: Mapping, key: Key, seed: int = 0) -> DataFrame:
    """Redraw profiled numeric columns with the profile's distribution.

    Keeps each column's mean, deviation, range and nulls.  Off by default:
    profiles carry skew, but the standard injection does not apply it.
    """
    from synthtab.plans.spec import ColumnSpec

    patterns = _numeric_patterns(df, profile.get("skew_profiles", {}))
    patterns = {c: p for c, p in patterns.items() if p.get("distribution_hint") in SAMPLERS}
    if not patterns:
        return df
    values = {c: as_double(df, c) for c in patterns}
    aggs = []
    for v in values.values():
        aggs += [F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)]
    row = df.agg(*aggs).first()
    changes = {}
    for i, (c, p) in enumerate(patterns.items()):
        mean, std, low, high = row[4 * i : 4 * i + 4]
        if mean is None:
            continue
        # measured from the lowest value, where every sampler is well behaved
        spec = ColumnSpec(c, "numeric", p["distribution_hint"], mean - low, std, 0.0, high - low)
        drawn = SAMPLERS[spec.hint](spec, _draw(df, key, seed, f"{c}:skew"))
        changes[c] = F.when(values[c].isNotNull(), drawn + F.lit(low))
    return _replace(df, changes)


# ---- whole profile -------------------------------------------------------------------


def apply_profile(
    df: DataFrame,
    profile: Mapping,
    key: Key,
    seed: int = 0,
    nulls: bool = True,
    outliers: bool = True,
    noise: bool = True,
    skew: bool = False,
) -> DataFrame:
    """Nulls, then outliers (which may overwrite nulls), then noise."""
    if skew:
        df = apply_skew(df, profile, key, seed)
    if nulls:
        df = inject_nulls(df, profile, key, seed)
    if outliers:
        df = inject_outliers(df, profile, key, seed)
    if noise:
        df = inject_noise(df, profile, key, seed)
    return df
