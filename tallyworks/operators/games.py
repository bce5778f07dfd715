"""Video games: platforms, genres, regional preference and score tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import tier
from .distribution import share_within
from .summary import totals_with_share


def platform_overview(
    df: DataFrame, platform: str, title: str, sales: str, year: str
) -> DataFrame:
    """Titles, sales, first and last year of each platform."""
    return df.groupBy(platform).agg(
        F.count_distinct(title).alias("titles"),
        F.sum(sales).alias("sales"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )


def sales_by(df: DataFrame, by: list[str], sales: str) -> DataFrame:
    """Sales volume and share of the whole by genre or another grouping."""
    return totals_with_share(df, by, sales)


def regional_preference(df: DataFrame, regions: list[str], category: str) -> DataFrame:
    """Sales, share and rank of each category in each region.

    ``regions`` are columns with the sales of one region each. They are summed per
    category before they are turned into rows, so the turning and the ranking touch one
    row per category and region. A category without sales in a region is kept with 0.
    """
    totals = df.groupBy(category).agg(*[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in regions])
    long = totals.unpivot([category], regions, "region", "sales")
    best = Window.partitionBy("region").orderBy(F.col("sales").desc())
    return share_within(long, "sales", ["region"]).withColumn("place", F.rank().over(best))


def score_tier(df: DataFrame, score: str, cuts: list[float], name: str | None = None) -> DataFrame:
    """Add the low, middle or high tier of a score. A missing score has no tier."""
    labels = ["low", "middle", "high"]
    return df.withColumn(name or f"{score}_tier", tier(F.col(score), cuts, labels))
