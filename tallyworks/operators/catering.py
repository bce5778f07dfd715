"""Catering market: structure, check and rating, their relation, niches to open."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bin_index, mean, number, ratio, student_tail
from .distribution import combine, quantiles, rank_correlation, rank_rows
from .summary import counts_with_share


def structure(df: DataFrame, by: list[str]) -> DataFrame:
    """Establishments and their share by niche, district or an operating feature."""
    return counts_with_share(df, by)


def check_and_rating(
    df: DataFrame, by: list[str], check: str, rating: str, exact: bool = True
) -> DataFrame:
    """Establishments, median check and mean rating in each group."""
    return combine(
        by,
        df.groupBy(*by).agg(F.count("*").alias("n"), mean(df, rating).alias("mean_rating")),
        quantiles(df, by, {"median_check": check}, exact=exact),
    )


def relation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of two measures and the line of ``y`` on ``x``, over complete pairs.

    A pair with a null or NaN is not complete.
    """
    a, b = number(df, x).cast("double"), number(df, y).cast("double")
    pairs = df.filter(a.isNotNull() & b.isNotNull())
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.corr(a, b).alias("corr"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_r2(b, a).alias("r2"),
    )


def rank_relation(df: DataFrame, x: str, y: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Monotone relation of two measures per group: rank correlation and its test.

    The statistic has Student's distribution with ``n - 2`` degrees of freedom if the
    measures are independent, for ten pairs or more closely enough. A perfect relation has p-value 0; without
    three pairs there is none.
    """
    found = rank_correlation(df, x, y, by)
    rho, free = F.col("rho"), F.col("n") - 2
    t = ratio(rho * F.sqrt(free.cast("double")), F.sqrt(F.greatest(1 - rho * rho, F.lit(0.0))))
    tested = found.withColumn("t", F.when(free > 0, t))
    exact = (free > 0) & (F.abs(rho) >= 1)
    p = F.when(exact, F.lit(0.0)).otherwise(student_tail(F.col("t"), free))
    return tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") <= alpha)


def rating_by_check(
    df: DataFrame, check: str, rating: str, low: float, high: float, bins: int
) -> DataFrame:
    """Mean rating per equal-width band of the check."""
    position = bin_index(F.col(check), F.lit(low), F.lit(high), bins)
    return (
        df.filter(number(df, check).isNotNull())
        .groupBy(position.alias("check_band"))
        .agg(F.count(number(df, rating)).alias("n"), mean(df, rating).alias("mean_rating"))
    )


def rank_niches(df: DataFrame, niche: str, check: str, rating: str) -> DataFrame:
    """Niches by median check, those rated at least as the whole market first.

    A niche below the market's mean rating is listed without a place, so that all parts
    of the ranking stay visible.
    """
    market = df.agg(mean(df, rating))
    niches = check_and_rating(df, [niche], check, rating).withColumn("market_rating", market.scalar())
    eligible = F.col("mean_rating") >= F.col("market_rating")
    marked = niches.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    # Others rank behind as nulls, so they do not move the places of the eligible.
    ranked = rank_rows(
        marked.withColumn("_check", F.when(F.col("eligible"), F.col("median_check"))),
        "_check",
        "place",
    )
    return ranked.withColumn("place", F.when(F.col("_check").isNotNull(), F.col("place"))).drop("_check")
