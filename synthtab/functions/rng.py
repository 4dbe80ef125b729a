"""Deterministic uniforms: a pure function of (seed, stream, part, row key).

``F.rand`` depends on how the rows are partitioned, so a retried task or a
different cluster size would change the data.  Here every draw is an MD5 of
the row key, which any engine can reproduce.  One digest yields two uniforms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthtab.functions.columns import epoch_micros

_TWO_52 = float(2**52)


def row_key(df: DataFrame, key: str | Sequence[str]) -> Column:
    """Text form of the row key; numbers and dates are written as integers."""
    names = [key] if isinstance(key, str) else list(key)
    parts = []
    for name in names:
        kind = df.schema[name].dataType
        col = F.col(f"`{name}`")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = epoch_micros(df, name)
        elif isinstance(kind, T.DateType):
            col = F.unix_date(col)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            raise ValueError(f"key column '{name}' is floating point; use integers, dates or text")
        parts.append(col.cast("string"))
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


class Draw:
    """The random numbers of one (seed, stream, part) for the row key ``key``."""

    def __init__(self, key: Column, seed: int, stream: str, part: int = 0):
        self.digest = F.md5(F.concat(F.lit(f"{seed}|{stream}|{part}|"), key))

    def _uniform(self, start: int) -> Column:
        whole = F.conv(F.substring(self.digest, start, 13), 16, 10).cast("bigint")
        return (whole + F.lit(0.5)) / F.lit(_TWO_52)

    @property
    def u1(self) -> Column:
        """Uniform in (0, 1); never exactly 0 or 1."""
        return self._uniform(1)

    @property
    def u2(self) -> Column:
        """A second uniform from the other half of the same digest."""
        return self._uniform(14)

    def normal(self) -> Column:
        """Standard normal (Box-Muller)."""
        radius = F.sqrt(F.lit(-2.0) * F.ln(self.u1))
        return radius * F.cos(F.lit(2.0) * F.pi() * self.u2)

    def integer(self, low: int, high: int, second: bool = False) -> Column:
        """Integer in [low, high)."""
        u = self.u2 if second else self.u1
        return F.floor(u * F.lit(float(high - low))).cast("bigint") + F.lit(low).cast("bigint")

    def pick(self, values: Sequence[str], second: bool = False) -> Column:
        """One of ``values`` with equal chances."""
        place = self.integer(1, len(values) + 1, second).cast("int")
        return F.element_at(F.array(*[F.lit(v) for v in values]), place)

    def weighted_pick(self, values: Sequence[str], weights: Sequence[float]) -> Column:
        """One of ``values`` with the given chances."""
        total, out = 0.0, None
        for value, weight in list(zip(values, weights))[:-1]:
            total += weight
            test = self.u1 < F.lit(total)
            out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
        return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))
