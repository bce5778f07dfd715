"""Company rating: profitability, growth, leaders of a sector and the rating table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import number, ratio
from .distribution import rank_rows
from .scope import in_region, min_revenue


def return_on_sales(
    df: DataFrame, profit: str = "sales_profit", revenue: str = "revenue", name: str = "ros"
) -> DataFrame:
    """Add profit from sales over revenue; null where revenue is missing or not positive."""
    positive = F.when(F.col(revenue) > 0, F.col(revenue))
    return df.withColumn(name, ratio(F.col(profit), positive))


def growth(df: DataFrame, key: str, year: str, measure: str) -> DataFrame:
    """Add ``<measure>_growth``, the rate against the year before, and ``<measure>_from_loss``.

    ``df`` has one row per key and year, so a window holds one company's years. The rate
    is null unless the row before is exactly one year earlier and its value is positive;
    a base of zero or below sets the flag instead. NaN counts as null.
    """
    history = Window.partitionBy(key).orderBy(year)
    base = F.when(F.lag(year).over(history) == F.col(year) - 1, F.lag(number(df, measure)).over(history))
    return df.withColumn("_base", base).withColumns(
        {
            f"{measure}_growth": ratio(
                number(df, measure), F.when(F.col("_base") > 0, F.col("_base"))
            )
            - 1,
            f"{measure}_from_loss": F.coalesce(F.col("_base") <= 0, F.lit(False)),
        }
    ).drop("_base")


def leaders(df: DataFrame, sector: str, measure: str, n: int = 1) -> DataFrame:
    """Rows with the ``n`` highest places of their sector by ``measure``; ties share a place.

    Null and NaN measures come last.

    The filter sits on the rank, so each task sends only its own candidates to the shuffle.
    """
    place = F.rank().over(Window.partitionBy(sector).orderBy(number(df, measure).desc_nulls_last()))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def rating(
    df: DataFrame,
    year: int,
    region: str,
    threshold: float,
    measures: tuple[str, ...] = ("revenue", "net_profit"),
    capacity: str = "cap_region",
) -> DataFrame:
    """Rating of a region's companies by the year's revenue.

    ``df`` is a company-year table. Years other than the rated one and the one before are
    not read. Ties share a place. The companies above the threshold are written once
    before they are placed, see ``rank_rows``.
    """
    recent = df.filter(F.col("year").between(year - 1, year))
    for measure in measures:
        recent = growth(recent, "company_id", "year", measure)
    scoped = min_revenue(in_region(recent, region, capacity=capacity), year, threshold)
    rated = return_on_sales(scoped).select(
        "company_id",
        "sector",
        "revenue",
        "ros",
        *[c for m in measures for c in (f"{m}_growth", f"{m}_from_loss")],
    )
    return rank_rows(rated, "revenue", "place")
