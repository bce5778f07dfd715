"""Event tickets: seasonality, popularity and its change, devices, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day, mean, number, ratio
from .distribution import combine, join_on, quantiles
from .summary import counts_with_share


def period_start(col: str | Column, unit: str) -> Column:
    """First day of the day, week (Monday), month, quarter or year."""
    start = day(col)
    return start if unit == "day" else F.trunc(start, unit)


def seasonality(df: DataFrame, ts: str, unit: str, user: str) -> DataFrame:
    """Orders and distinct users per period."""
    return df.groupBy(period_start(ts, unit).alias("period")).agg(
        F.count("*").alias("n"), F.count_distinct(user).alias("users")
    )


def popularity(df: DataFrame, by: list[str]) -> DataFrame:
    """Count and share of event types, or of single events."""
    return counts_with_share(df, by)


def share_change(df: DataFrame, ts: str, unit: str, category: str) -> DataFrame:
    """Share of each category in its period and its change against the period before.

    The period before is the calendar's, not the previous row's: a category without rows
    there counts as share 0, also one that has just vanished; when that whole period has
    no rows the change is null. Every row is counted in its own period and, as the
    earlier count, in the next one, so categories need no grid and no window.
    """
    step = {
        "day": F.make_interval(days=F.lit(1)),
        "week": F.make_interval(weeks=F.lit(1)),
        "month": F.make_interval(months=F.lit(1)),
        "quarter": F.make_interval(months=F.lit(3)),
        "year": F.make_interval(years=F.lit(1)),
    }[unit]
    counts = df.groupBy(period_start(ts, unit).alias("period"), category).agg(
        F.count("*").alias("n")
    )
    zero = F.lit(0).cast("bigint")
    now = counts.withColumn("before", zero)
    later = counts.select(
        (F.col("period") + step).cast("date").alias("period"),
        category,
        zero.alias("n"),
        F.col("n").alias("before"),
    )
    paired = (
        now.unionByName(later)
        .groupBy("period", category)
        .agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
    )
    # Both totals of a period from the same counts; periods without rows fall away.
    totals = (
        now.unionByName(later)
        .groupBy("period")
        .agg(F.sum("n").alias("_total"), F.sum("before").alias("_total_before"))
        .filter(F.col("_total") > 0)
    )
    shares = join_on(paired, totals, ["period"])
    return shares.select(
        "period",
        category,
        "n",
        ratio(F.col("n"), F.col("_total")).alias("share"),
        ratio(F.col("before"), F.col("_total_before")).alias("share_before"),
    ).withColumn("change", F.col("share") - F.col("share_before"))


def activity_by(df: DataFrame, device: str, user: str) -> DataFrame:
    """Users, actions and actions per user by device; a user of two devices counts in both."""
    return (
        df.groupBy(device)
        .agg(F.count_distinct(user).alias("users"), F.count("*").alias("actions"))
        .withColumn("actions_per_user", ratio(F.col("actions"), F.col("users")))
    )


def price_profile(df: DataFrame, by: list[str], price: str, exact: bool = True) -> DataFrame:
    """Level and spread of prices: count, mean, deviation, median and quartiles."""
    levels = df.groupBy(*by).agg(
        F.count(number(df, price)).alias("n"),
        mean(df, price).alias("mean_price"),
        F.stddev_samp(number(df, price).cast("double")).alias("stddev_price"),
    )
    spread = quantiles(
        df, by, {"price": price}, {"_q1": 0.25, "_median": 0.5, "_q3": 0.75}, exact=exact
    )
    return combine(by, levels, spread)
