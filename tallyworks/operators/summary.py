"""Group summaries that serve several kinds of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import known, mean, number
from .distribution import share_of_total


def counts_with_share(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Rows per group and the group's share of all rows."""
    return share_of_total(df.groupBy(*by).agg(F.count("*").alias(name)), name)


def totals_with_share(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Sum of a measure per group and the group's share of the whole sum."""
    return share_of_total(df.groupBy(*by).agg(F.sum(number(df, measure)).alias(measure)), measure)


def avg_length(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Mean of a column per group with the number of values behind it."""
    return df.groupBy(*by).agg(F.count(number(df, col)).alias("n"), mean(df, col).alias(f"mean_{col}"))


def avg_distinct_per(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Mean over ``outer`` of the number of distinct ``inner`` in each."""
    per_outer = df.groupBy(outer).agg(F.count_distinct(inner).alias("_n"))
    return per_outer.agg(
        F.count("*").alias(f"{outer}s"), F.avg("_n").alias(f"mean_{inner}s")
    )


def top_k(df: DataFrame, measure: str | Column, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` rows with the highest measure; ``tie`` columns decide between equals.

    Null and NaN come last.
    """
    column = number(df, measure) if isinstance(measure, str) else known(measure)
    return df.orderBy(column.desc_nulls_last(), *tie).limit(k)
