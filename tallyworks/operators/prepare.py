"""Preparation: duplicates, missing values, text and types, outliers, derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import known
from .distribution import attach, quantiles


def dedupe(
    df: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None
) -> DataFrame:
    """Keep the first row per key in ``order``; without keys, drop repeated whole rows.

    ``order`` should break every tie, or the kept row is not determined. The filter sits
    on the row number, so Spark keeps one row per key and task before the shuffle and a
    key with very many copies does not burden one task.
    """
    if keys is None:
        return df.dropDuplicates()
    if not order:
        raise ValueError("an order is needed to choose a row per key")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def fill_missing(
    df: DataFrame,
    col: str,
    how: str,
    by: list[str] | None = None,
    value: object = None,
    exact: bool = True,
) -> DataFrame:
    """Deal with nulls of one column: ``drop`` the rows, or fill by ``constant`` or ``median``.

    The median is that of the row's group, computed from the known values; a group
    without known values stays null. NaN counts as null for the median.
    """
    if how == "drop":
        return df.dropna(subset=[col])
    if how == "constant":
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    if how != "median":
        raise ValueError(f"unknown way to fill: {how}")
    by = by or []
    kind = df.schema[col].dataType
    median = quantiles(df, by, {"_median": known(F.col(col))}, exact=exact)
    if not by:
        return df.withColumn(col, F.coalesce(known(F.col(col)), median.scalar().cast(kind)))
    filled = attach(df, median, by, how="left")
    return filled.withColumn(col, F.coalesce(known(F.col(col)), F.col("_median").cast(kind))).drop("_median")


def normalise(
    df: DataFrame, text: list[str] | None = None, casts: dict[str, str] | None = None
) -> DataFrame:
    """Trim, lower and single-space text columns; cast others, flagging what cannot be cast.

    Each cast column ``c`` becomes null where its text does not fit the type, and
    ``c_failed`` marks those rows.
    """
    changes = {c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))) for c in text or []}
    for c, kind in (casts or {}).items():
        changes[c] = F.col(c).try_cast(kind)
        changes[f"{c}_failed"] = F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
    return df.withColumns(changes)


def failed_casts(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """One row with the number of values of each column that do not fit the wanted type."""
    return df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c)
            for c, kind in casts.items()
        ]
    )


def _fenced(df: DataFrame, col: str, by: list[str], fences: DataFrame, drop: bool) -> DataFrame:
    if by:
        fenced = attach(df, fences, by, how="left")
    else:
        both = fences.select(F.struct("lower", "upper")).scalar()
        fenced = df.withColumn("_f", both).withColumns(
            {"lower": F.col("_f.lower"), "upper": F.col("_f.upper")}
        ).drop("_f")
    value = known(F.col(col))
    outside = (value < F.col("lower")) | (value > F.col("upper"))
    flagged = fenced.withColumn("is_outlier", F.coalesce(outside, F.lit(False)))
    return flagged.filter(~F.col("is_outlier")).select(*df.columns) if drop else flagged


def iqr_fence(
    df: DataFrame, col: str, by: list[str], k: float = 1.5, exact: bool = True, drop: bool = False
) -> DataFrame:
    """Add ``lower`` and ``upper`` fence of the row's group and ``is_outlier``.

    The fences lie ``k`` interquartile ranges outside the quartiles; a value on a fence
    is inside. A null or NaN value is not an outlier. With ``drop`` the outliers go and
    no column is added.
    """
    quartiles = quantiles(df, by, {"_q": known(F.col(col))}, {"1": 0.25, "3": 0.75}, exact)
    spread = k * (F.col("_q3") - F.col("_q1"))
    fences = quartiles.select(
        *by, (F.col("_q1") - spread).alias("lower"), (F.col("_q3") + spread).alias("upper")
    )
    return _fenced(df, col, by, fences, drop)


def quantile_fence(
    df: DataFrame, col: str, by: list[str], low: float = 0.01, high: float = 0.99,
    exact: bool = True, drop: bool = False,
) -> DataFrame:
    """As ``iqr_fence``, with two quantiles of the row's group as the fences."""
    if not 0 <= low < high <= 1:
        raise ValueError("need 0 <= low < high <= 1")
    bounds = quantiles(df, by, {"": known(F.col(col))}, {"lower": low, "upper": high}, exact)
    return _fenced(df, col, by, bounds, drop)


def derive(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns."""
    return df.withColumns(columns)


def explode_topics(df: DataFrame, col: str, separator: str | None = None) -> DataFrame:
    """One row per distinct topic of a row; rows without topics drop out.

    ``col`` is an array, or with ``separator`` a text that is split at that pattern. The
    result has ``topic`` in place of ``col``.
    """
    topics = F.col(col)
    if separator is not None:
        topics = F.transform(F.split(col, separator), lambda t: F.trim(t))
    rows = df.withColumn("topic", F.explode(F.array_distinct(topics))).drop(col)
    return rows.filter(F.col("topic") != "")
