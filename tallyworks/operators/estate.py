"""Property market: value by type, typical parameters, and both by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import band, ratio
from .distribution import combine, modes, quantiles


def _value(price: str, area: str) -> dict[str, Column]:
    per_area = ratio(F.col(price), F.when(F.col(area) > 0, F.col(area)))
    return {"median_price": F.col(price), "median_price_per_area": per_area}


def _numbers(numeric: list[str]) -> dict[str, Column]:
    return {f"median_{c}": F.col(c) for c in numeric}


def _summary(
    df: DataFrame, by: list[str], medians: dict[str, Column], categorical: list[str], exact: bool
) -> DataFrame:
    """Rows, medians and most frequent values per group; all medians share their shuffles."""
    parts = [df.groupBy(*by).agg(F.count("*").alias("n"))]
    if medians:
        parts.append(quantiles(df, by, medians, exact=exact))
    if categorical:
        frequent = modes(df, by, categorical)
        parts.append(frequent.withColumnsRenamed({c: f"mode_{c}" for c in categorical}))
    return combine(by, *parts)


def market_value(
    df: DataFrame, by: list[str], price: str, area: str, exact: bool = True
) -> DataFrame:
    """Listings, median price and median price per unit of area in each group."""
    return _summary(df, by, _value(price, area), [], exact)


def typical(
    df: DataFrame,
    by: list[str],
    numeric: list[str],
    categorical: list[str],
    exact: bool = True,
) -> DataFrame:
    """Median of numeric and most frequent value of text parameters in each group."""
    return _summary(df, by, _numbers(numeric), categorical, exact)


def by_distance(
    df: DataFrame,
    distance: str,
    edges: list[float],
    by: list[str],
    price: str,
    area: str,
    numeric: list[str],
    categorical: list[str],
    exact: bool = True,
) -> DataFrame:
    """Market value and typical parameters per left-closed distance band.

    Rows outside all bands have a null band, so that none is lost silently.
    """
    banded = df.withColumn("distance_band", band(F.col(distance), edges))
    medians = {**_value(price, area), **_numbers(numeric)}
    return _summary(banded, ["distance_band", *by], medians, categorical, exact)
