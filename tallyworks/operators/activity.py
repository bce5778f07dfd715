"""User activity kept as bitmaps: retention and active users over any window from one pass.

A user's active days or months are bits of 64-bit words, combined by ``or`` on the map side,
so the actions are shuffled once, by user, as one short row a user and task. The table can
be stored; everything below reads nothing else.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import day, ratio
from .scope import in_period

WORD = 64


def _index(period: Column, first: date, unit: str) -> Column:
    """Periods since that of ``first``."""
    if unit == "day":
        return F.date_diff(period, F.lit(first))
    return (F.year(period) - first.year) * 12 + F.month(period) - first.month


def _period(index: Column, first: date, unit: str) -> Column:
    """The period at an index, a month by its first day."""
    if unit == "day":
        return F.date_add(F.lit(first), index)
    return F.add_months(F.lit(first.replace(day=1)), index)


def _span(first: date, last: date, unit: str) -> int:
    """Periods from ``first`` to ``last``, both counted."""
    if unit not in ("day", "month"):
        raise ValueError(f"unknown unit: {unit}")
    if last < first:
        raise ValueError("the period ends before it begins")
    if unit == "day":
        return (last - first).days + 1
    return (last.year - first.year) * 12 + last.month - first.month + 1


def activity(df: DataFrame, user: str, ts: str, first: str, last: str, unit: str = "day") -> DataFrame:
    """One row per user active from ``first`` to ``last``: ``active``, an array of words.

    Bit i of word j is period ``64 j + i``. The number of words follows from the period,
    so a row's size does not depend on the number of actions. Rows without a user are
    left out.
    """
    begin, end = date.fromisoformat(first), date.fromisoformat(last)
    words = -(-_span(begin, end, unit) // WORD)
    rows = in_period(df.filter(F.col(user).isNotNull()), ts, first, last)
    index = _index(day(ts), begin, unit)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), index % WORD)
    here = [F.when(F.floor(index / WORD) == j, bit) for j in range(words)]
    return rows.groupBy(user).agg(F.array(*[F.coalesce(F.bit_or(x), F.lit(0)) for x in here]).alias("active"))


def merge(states: DataFrame, user: str) -> DataFrame:
    """Several activity tables of the same period as one: each user's words or-ed."""
    words = F.transform(
        F.sequence(F.lit(0), F.size(F.element_at("_all", 1)) - 1),
        lambda j: F.aggregate(
            F.transform("_all", lambda a: F.get(a, j)), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y)
        ),
    )
    # As many rows a user as there are tables.
    return states.groupBy(user).agg(F.collect_list("active").alias("_all")).select(user, words.alias("active"))


def active_indexes(active: Column, periods: int) -> Column:
    """The indexes of the set bits in rising order."""
    is_set = lambda i: F.bit_get(F.get(active, F.floor(i / WORD).cast("int")), i % WORD) == 1
    return F.filter(F.sequence(F.lit(0), F.lit(periods - 1)), is_set)


def retention_all(state: DataFrame, first: str, last: str, ages: int, unit: str = "day") -> DataFrame:
    """Users of each cohort active again 1 to ``ages`` periods after their first one.

    One row for each cohort and age that the period still covers, also where nobody came
    back. ``state`` is an ``activity`` table of the same period.
    """
    begin, end = date.fromisoformat(first), date.fromisoformat(last)
    periods = _span(begin, end, unit)
    seen = state.select(active_indexes(F.col("active"), periods).alias("_at")).filter(F.size("_at") > 0)
    start = F.element_at("_at", 1)
    came = F.filter(F.transform("_at", lambda i: i - start), lambda age: age <= ages)
    counts = (
        seen.select(start.alias("_cohort"), F.explode(came).alias("age"))
        .groupBy("_cohort", "age")
        .agg(F.count("*").alias("users"))
    )
    # A cohort's map has no more entries than there are ages.
    filled = counts.groupBy("_cohort").agg(F.map_from_entries(F.collect_list(F.struct("age", "users"))).alias("_users"))
    every = F.sequence(F.lit(0), F.least(F.lit(ages), F.lit(periods - 1) - F.col("_cohort")))
    users = F.coalesce(F.col("_users")[F.col("age")], F.lit(0).cast("bigint"))
    return filled.withColumn("age", F.explode(every)).select(
        _period(F.col("_cohort"), begin, unit).alias("cohort"),
        "age",
        users.alias("users"),
        F.col("_users")[0].alias("cohort_size"),
        ratio(users, F.col("_users")[0]).alias("retention"),
    )


def rolling_users(state: DataFrame, first: str, last: str, windows: list[int], unit: str = "day") -> DataFrame:
    """For each period the users active in it or the ``w - 1`` before, as ``users_<w>``.

    A user is counted from a first to a last period by one step up and one down, so a user
    gives two rows for each run of activity and no distinct count is needed. Windows that
    reach back before ``first`` hold what is known: let the table begin earlier.
    """
    begin, end = date.fromisoformat(first), date.fromisoformat(last)
    periods = _span(begin, end, unit)
    at = F.col("_at")

    def steps(w: int) -> Column:
        step = lambda place, change: F.struct(F.lit(w).alias("w"), place.alias("at"), F.lit(change).alias("change"))
        ups = F.transform(F.filter(at, lambda d, i: (i == 0) | (d > F.get(at, i - 1) + w)), lambda d: step(d, 1))
        behind = lambda d, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > d + w)
        downs = F.transform(F.filter(at, behind), lambda d: step(d + w, -1))
        return F.concat(ups, F.filter(downs, lambda s: s["at"] < periods))

    seen = state.select(active_indexes(F.col("active"), periods).alias("_at"))
    moved = seen.select(F.explode(F.concat(*[steps(w) for w in windows])).alias("_s")).select("_s.*")
    grid = state.sparkSession.range(periods).select(
        F.explode(F.array(*[F.lit(w) for w in windows])).alias("w"), F.col("id").cast("int").alias("at"),
        F.lit(0).alias("change"),
    )
    changes = moved.unionByName(grid).groupBy("w", "at").agg(F.sum("change").alias("change"))
    # One row per period in each window partition.
    running = F.sum("change").over(Window.partitionBy("w").orderBy("at"))
    counted = changes.withColumn("users", running)
    return counted.groupBy(_period(F.col("at"), begin, unit).alias("period")).agg(
        *[F.max(F.when(F.col("w") == w, F.col("users"))).alias(f"users_{w}") for w in windows]
    )
