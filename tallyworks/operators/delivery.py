"""Product metrics of a delivery service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import day, ratio


def dau(df: DataFrame, user: str, ts: str, exact: bool = True) -> DataFrame:
    """Distinct users of each day that has any. ``exact=False`` estimates with a sketch."""
    df = df.filter(F.col(user).isNotNull())
    users = F.count_distinct(user) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(user))
    return df.groupBy(day(ts).alias("day")).agg(users.alias("dau"))


def daily_sketches(df: DataFrame, user: str, ts: str) -> DataFrame:
    """A sketch of each day's users, to be stored and merged by ``active_users``."""
    return df.filter(F.col(user).isNotNull()).groupBy(day(ts).alias("day")).agg(F.hll_sketch_agg(user).alias("sketch"))


def active_users(sketches: DataFrame, unit: str) -> DataFrame:
    """Estimated distinct users per week or month from daily sketches alone."""
    return sketches.groupBy(F.trunc("day", unit).alias("period")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users")
    )


def conversion(df: DataFrame, user: str, ts: str, is_target: Column) -> DataFrame:
    """Share of each day's active users who did the target action that day."""
    # One row per user and day first, so that only one distinct count is needed.
    users = df.groupBy(day(ts).alias("day"), user).agg(F.max(is_target).alias("_done"))
    return (
        users.filter(F.col(user).isNotNull())
        .groupBy("day")
        .agg(F.count("*").alias("users"), F.count_if("_done").alias("converted"))
        .withColumn("cr", ratio(F.col("converted"), F.col("users")))
    )


def aov(df: DataFrame, order: str, value: str, ts: str) -> DataFrame:
    """Orders, their value and the average value per month. Rows may be order lines."""
    return (
        df.groupBy(F.trunc(day(ts), "month").alias("month"))
        .agg(F.count_distinct(order).alias("orders"), F.sum(value).alias("value"))
        .withColumn("aov", ratio(F.col("value"), F.col("orders")))
    )


def repeat_purchase_rate(df: DataFrame, user: str, order: str) -> DataFrame:
    """Buyers, buyers with two or more orders, and the latter's share; no buyer is null."""
    per_user = df.filter(F.col(user).isNotNull()).groupBy(user).agg(F.count_distinct(order).alias("_orders"))
    return per_user.agg(
        F.count("*").alias("buyers"), F.count_if(F.col("_orders") >= 2).alias("repeat_buyers")
    ).withColumn("repeat_rate", ratio(F.col("repeat_buyers"), F.col("buyers")))


def retention(df: DataFrame, user: str, ts: str, unit: str = "month") -> DataFrame:
    """Share of each cohort that is active again N days or months after its first.

    Users are reduced to their active periods first, so the window that finds a user's
    first period holds no more rows than the calendar has periods. Rows without a user
    are left out.
    """
    df = df.filter(F.col(user).isNotNull())
    period = day(ts) if unit == "day" else F.trunc(day(ts), "month")
    active = df.select(F.col(user).alias("_user"), period.alias("_period")).distinct()
    first = active.withColumn("cohort", F.min("_period").over(Window.partitionBy("_user")))
    if unit == "day":
        age = F.date_diff("_period", "cohort")
    else:
        age = F.months_between("_period", "cohort").cast("int")
    counts = first.groupBy("cohort", age.alias("age")).agg(F.count("*").alias("users"))
    # One row per age in each window partition.
    size = F.max(F.when(F.col("age") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return counts.withColumn("cohort_size", size).withColumn(
        "retention", ratio(F.col("users"), F.col("cohort_size"))
    )


def restaurant_ltv(df: DataFrame, restaurant: str, margin: str, customer: str) -> DataFrame:
    """Margin of each restaurant over the period, in all and per distinct customer."""
    return (
        df.groupBy(restaurant)
        .agg(F.sum(margin).alias("ltv"), F.count_distinct(customer).alias("customers"))
        .withColumn("ltv_per_customer", ratio(F.col("ltv"), F.col("customers")))
    )
