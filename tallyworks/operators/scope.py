"""Which rows belong to an analysis, and attributes joined to them."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

from .distribution import join_on


def min_revenue(
    df: DataFrame, year: int, threshold: float, year_col: str = "year", revenue: str = "revenue"
) -> DataFrame:
    """Rows of one year with at least the threshold of revenue (bound included)."""
    return df.filter((F.col(year_col) == year) & (F.col(revenue) >= threshold))


def in_region(
    df: DataFrame, region: str, registered: str = "reg_region", capacity: str = "cap_region"
) -> DataFrame:
    """Companies registered in the region or with main capacity there, or both.

    ``capacity`` is one region or an array of regions.
    """
    here = F.col(capacity)
    if isinstance(df.schema[capacity].dataType, ArrayType):
        has_capacity = F.array_contains(here, region)
    else:
        has_capacity = here == region
    return df.filter((F.col(registered) == region) | has_capacity)


def in_region_by_capacity(
    df: DataFrame, region: str, capacity: DataFrame, on: list[str], registered: str = "reg_region"
) -> DataFrame:
    """As ``in_region``, with capacity listed in a table of ``on`` columns and ``region``."""
    here = capacity.filter(F.col("region") == region).select(*on).distinct()
    marked = join_on(df, here.withColumn("_here", F.lit(True)), on, "left")
    return marked.filter((F.col(registered) == region) | F.col("_here")).drop("_here")


def moment(bound: object) -> date:
    """A bound as a day, or as a time if it has one."""
    if isinstance(bound, str):
        return date.fromisoformat(bound) if len(bound) <= 10 else datetime.fromisoformat(bound)
    return bound


def in_period(df: DataFrame, col: str, first: object, last: object) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; days or times for a date or timestamp column.

    A last day counts whole, as a half-open range; a last time is included as given. Both
    reach the Parquet scan. Strings with a time are times; a date column takes their days.
    """
    kind = df.schema[col].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        first, last = (moment(x) for x in (first, last))
        if isinstance(kind, DateType):
            first, last = (x.date() if isinstance(x, datetime) else x for x in (first, last))
        after = F.col(col) >= F.lit(first.isoformat()).cast(kind)
        if isinstance(last, datetime):
            return df.filter(after & (F.col(col) <= F.lit(last.isoformat()).cast(kind)))
        behind = F.lit((last + timedelta(days=1)).isoformat()).cast(kind)
        return df.filter(after & (F.col(col) < behind))
    return df.filter((F.col(col) >= first) & (F.col(col) <= last))


def in_place(df: DataFrame, col: str, values: list) -> DataFrame:
    """Rows at one of the listed places."""
    return df.filter(F.col(col).isin(*values))


def unique(dim: DataFrame, on: list[str]) -> DataFrame:
    """``dim``, which fails when it runs if a key is repeated. Null keys match nothing."""
    keyed = dim.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
    most = keyed.groupBy(*on).agg(F.count("*").alias("_n")).agg(F.max("_n")).scalar()
    failure = F.raise_error(F.lit(f"a key of {', '.join(on)} is repeated in the dimension")).cast("boolean")
    return dim.filter(F.when(most > 1, failure).otherwise(F.lit(True)))


def enrich(fact: DataFrame, dim: DataFrame, on: list[str], check: bool = True) -> DataFrame:
    """Add a dimension's attributes to facts, keeping facts that have none.

    The dimension must have one row per key; a repeated one would double facts, so it is
    an error when the result is computed. The check counts the dimension's keys alone and
    leaves the facts and the join as they are; ``check=False`` skips it for a dimension
    known to be right. Spark broadcasts the dimension when its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and else shuffles, splitting skewed keys.
    """
    return fact.join(unique(dim, on) if check else dim, on, "left")
