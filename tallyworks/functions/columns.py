"""Column expressions shared by the operators. All but the p-value stay in the JVM."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, TimestampNTZType

# Factors below 2^31, so that products of 32-bit numbers stay below 2^63, and shifts.
HASH_ROUNDS = ((0x2C1B3C6D, 15), (0x297A2D39, 13))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; null where the denominator is zero or either side is null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def known(value: Column) -> Column:
    """The value, with NaN read as null: tables written from Python hold NaN for missing."""
    return F.when(value.cast("double") == float("nan"), F.lit(None)).otherwise(value)


def mean(df: DataFrame, col: str) -> Column:
    """Mean of a column. Decimals are summed exactly, so the order of rows is irrelevant."""
    if isinstance(df.schema[col].dataType, DecimalType):
        return ratio(F.sum(col), F.count(col))
    return F.avg(number(df, col))


def number(df: DataFrame, col: str) -> Column:
    """A column, with NaN read as null if its type has one."""
    if isinstance(df.schema[col].dataType, (DoubleType, FloatType)):
        return F.when(~F.isnan(col), F.col(col))
    return F.col(col)


def hash32(*parts: Column, seed: int = 0) -> Column:
    """A hash of whole numbers, 0 to 2^32 - 1, in arithmetic that any SQL engine can spell.

    Each part is folded to 32 bits and mixed in by two odd factors and two shifts.
    """
    low = F.lit((1 << 32) - 1)
    h = F.lit(seed).cast("long")
    for part in parts:
        part = part.cast("long")
        x = h.bitwiseXOR(part.bitwiseXOR(F.shiftrightunsigned(part, 32)).bitwiseAND(low))
        for factor, shift in HASH_ROUNDS:
            x = (x * factor).bitwiseAND(low)
            x = x.bitwiseXOR(F.shiftright(x, shift))
        h = x
    return h


def tier(value: Column, cuts: list[float], labels: list[str]) -> Column:
    """Label of the tier a value falls in; a value on a cut belongs to the upper tier.

    NaN counts as null.
    """
    value = known(value)
    if len(labels) != len(cuts) + 1 or sorted(cuts) != list(cuts):
        raise ValueError("need ascending cuts and one label more than cuts")
    result = F.when(value.isNull(), F.lit(None))
    for cut, label in zip(cuts, labels):
        result = result.when(value < cut, label)
    return result.otherwise(labels[-1])


def band(value: Column, edges: list[float]) -> Column:
    """Left-closed band ``[a,b)`` between neighbouring edges; null outside all bands."""
    if len(edges) < 2 or sorted(edges) != list(edges):
        raise ValueError("need at least two ascending edges")
    result = F.when(value < edges[0], F.lit(None))
    for low, high in zip(edges, edges[1:]):
        result = result.when(value < high, f"[{low},{high})")
    return result


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1. Values outside [low, high) go to the nearest end bin.

    A range of no width has everything in bin 0. NaN counts as null and has no bin.
    """
    value = known(value)
    position = F.coalesce(F.floor(F.try_divide((value - low) * bins, high - low)), F.lit(0))
    clamped = F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0))
    return F.when(value.isNotNull(), clamped).cast("int")


def day(col: str | Column) -> Column:
    """Calendar day of a date or timestamp, without moving it between time zones."""
    return F.to_date(F.col(col) if isinstance(col, str) else col)


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds on the column's own clock, for differences between timestamps."""
    c = F.col(col)
    kind = df.schema[col].dataType
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("bigint") * 86_400_000_000
    if isinstance(kind, TimestampNTZType):
        seconds = (
            F.unix_date(F.to_date(c)).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
        )
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.unix_micros(c)


def text_key(col: str | Column) -> Column:
    """Digest of a whole text, so that comparing texts does not shuffle them."""
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of a statistic. Meant for results, which are a few rows."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")
