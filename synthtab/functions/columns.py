"""Which columns count as numeric, and what counts as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
UTC_NAMES = ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), INTEGRAL)


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), FRACTIONAL)


def is_numeric(df: DataFrame, name: str) -> bool:
    return is_integral(df, name) or is_fractional(df, name)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    if isinstance(kind(df, name), (T.FloatType, T.DoubleType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def as_double(df: DataFrame, name: str) -> Column:
    """The numeric column as double, NaN as NULL."""
    value = col(name).cast("double")
    if isinstance(kind(df, name), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def epoch_micros(df: DataFrame, name: str) -> Column:
    """A date or timestamp as microseconds since 1970, whatever the session's time zone."""
    value, type_ = col(name), kind(df, name)
    if isinstance(type_, T.TimestampType):
        return F.unix_micros(value)
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(type_, T.TimestampNTZType) and zone in UTC_NAMES:
        return F.unix_micros(value.cast("timestamp"))  # the quick way to the same number
    seconds = F.unix_date(value.cast("date")).cast("bigint") * 86_400
    if isinstance(type_, T.DateType):
        return seconds * 1_000_000
    # a time without zone has no instant, so it is taken apart
    seconds = seconds + F.hour(value) * 3600 + F.minute(value) * 60
    part = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    return seconds * 1_000_000 + part
