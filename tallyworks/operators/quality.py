"""Data quality: profiles, rule violations, unevenness and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import mean, number, ratio
from .distribution import combine, quantiles, share_of_total


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct values, smallest and largest as text.

    NaN counts as null. All columns in one pass, with estimated distinct counts. ``exact=True`` counts them
    in a second pass, which shuffles every distinct value of every column; it is kept
    apart so that the minima and maxima do not travel with it.
    """
    aggs = [F.count("*").alias("rows")]
    values = [number(df, c) for c in df.columns]
    for i, c in enumerate(values):
        aggs += [
            F.count(c).alias(f"known_{i}"),
            F.min(c).cast("string").alias(f"min_{i}"),
            F.max(c).cast("string").alias(f"max_{i}"),
        ]
    count = F.count_distinct if exact else F.approx_count_distinct
    distinct = [count(c).alias(f"distinct_{i}") for i, c in enumerate(values)]
    if exact:
        counted = df.agg(*distinct).select(F.struct("*")).scalar()
        summary = df.agg(*aggs).withColumn("_d", counted).select("*", "_d.*")
    else:
        summary = df.agg(*aggs, *distinct)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows"),
            (F.col("rows") - F.col(f"known_{i}")).alias("nulls"),
            F.col(f"distinct_{i}").alias("distinct_values"),
            F.col(f"min_{i}").alias("min_value"),
            F.col(f"max_{i}").alias("max_value"),
        )
        for i, c in enumerate(df.columns)
    ]
    return summary.select(F.inline(F.array(*entries)))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows that break it and their share. A null outcome is no breach."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(broken).alias(f"_broken_{i}") for i, broken in enumerate(rules.values())],
    )
    entries = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"_broken_{i}").alias("violations"),
            ratio(F.col(f"_broken_{i}"), F.col("_rows")).alias("share"),
        )
        for i, name in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*entries)))


def copies(df: DataFrame, key: Column, rule: str) -> DataFrame:
    """The same row as in ``violations`` for repeated keys: rows beyond the first of each."""
    counts = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    return counts.agg(F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("_more")).select(
        F.lit(rule).alias("rule"),
        F.coalesce("_more", F.lit(0).cast("bigint")).alias("violations"),
        ratio(F.col("_more"), F.col("_rows")).alias("share"),
    )


def heterogeneity(df: DataFrame, category: str, x: str, exact: bool = True) -> DataFrame:
    """How unevenly rows and a measure spread: share, mean, relative deviation, quantiles.

    Null and NaN count as rows of their category and have no part in the measure.
    """
    value = number(df, x).cast("double")
    levels = df.groupBy(category).agg(
        F.count("*").alias("n"),
        mean(df, x).alias("mean"),
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"),
    )
    spread = quantiles(df, [category], {"p": x}, {"10": 0.1, "50": 0.5, "90": 0.9}, exact)
    # The total is counted apart, over no column, so that it does not repeat the levels.
    rows = df.agg(F.count("*")).scalar()
    return combine([category], levels, spread).withColumn("share", ratio(F.col("n"), rows))


def category_detail(df: DataFrame, category: str, x: str, exact: bool = True) -> DataFrame:
    """Rows, share of known values, their total and median in each category.

    NaN is not known.
    """
    value = number(df, x)
    levels = df.groupBy(category).agg(
        F.count("*").alias("n"),
        ratio(F.count(value), F.count("*")).alias("filled_share"),
        F.sum(value).alias("total"),
    )
    return combine([category], levels, quantiles(df, [category], {"median": x}, exact=exact))


def expect(df: DataFrame, rows: int, domain: str, size: int) -> DataFrame:
    """Compare the number of rows and of distinct values of a column with expectations."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(domain).alias("domain_size")
    ).withColumns({"rows_ok": F.col("rows") == rows, "domain_ok": F.col("domain_size") == size})
