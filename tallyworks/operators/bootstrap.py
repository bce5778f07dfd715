"""Intervals for differences of ratios when a user's sessions depend on each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from ..functions import hash32, number, ratio

# Poisson(1) counts above this have a probability below that of one hash value.
MOST = 12


def poisson_thresholds() -> list[int]:
    """The hash values from which a Poisson(1) weight is 1 and more, 2 and more, ..."""
    below = 0.0
    found = []
    for k in range(MOST):
        below += math.exp(-1) / math.factorial(k)
        found.append(math.floor(below * (1 << 32)))
    return found


def poisson_weight(h: Column) -> Column:
    """The Poisson(1) weight of a 32-bit hash."""
    weight = F.lit(0)
    for threshold in poisson_thresholds():
        weight = weight + (h >= threshold).cast("int")
    return weight


def bootstrap_ratio(
    df: DataFrame, group: str, user: str, top: str, bottom: str, a: object, b: object,
    by: list[str] | None = None, replicates: int = 1000, alpha: float = 0.05, seed: int = 1,
) -> DataFrame:
    """Percentile interval of the difference of sum(top) / sum(bottom), ``b`` minus ``a``.

    Users are drawn anew, with all they did: a user's weight in a replicate is a Poisson
    count that follows from seed, user and replicate alone, so it agrees in every task and
    on every run, and in both groups if a user is in both. Rows are added up per user
    first; then one aggregation has a row for each replicate, combined on the map side.

    One row for each group of ``by`` (one in all without): ``difference`` of the sample,
    ``low`` and ``high``, ``std_error``, ``replicates`` that have both ratios, and
    ``significant``, whether the interval leaves out zero. Rows without a user, or with a
    null or NaN in ``top`` or ``bottom``, are left out.
    """
    by = by or []
    x, y = number(df, top), number(df, bottom)
    units = (
        df.filter(F.col(user).isNotNull() & F.col(group).isin(a, b) & x.isNotNull() & y.isNotNull())
        .groupBy(*by, F.col(group).alias("_g"), F.col(user).alias("_user"))
        .agg(F.sum(x).alias("_x"), F.sum(y).alias("_y"))
    )
    whole = isinstance(df.schema[user].dataType, IntegralType)
    key = F.col("_user") if whole else F.xxhash64("_user")
    # Replicate 0 is the sample itself.
    drawn = units.withColumn("_key", key).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    weight = F.when(F.col("_r") == 0, 1).otherwise(poisson_weight(F.col("_h")))
    drawn = drawn.withColumn("_h", hash32(F.col("_key"), F.col("_r"), seed=seed)).withColumn("_w", weight)
    of = lambda g, c: F.sum(F.when(F.col("_g") == g, F.col("_w") * F.col(c)))
    sums = drawn.filter(F.col("_w") > 0).groupBy(*by, "_r").agg(
        *[of(g, c).alias(f"{c}{n}") for n, g in (("a", a), ("b", b)) for c in ("_x", "_y")]
    )
    difference = ratio(F.col("_xb"), F.col("_yb")) - ratio(F.col("_xa"), F.col("_ya"))
    each = sums.select(*by, "_r", difference.alias("_d"))
    again = F.when(F.col("_r") > 0, F.col("_d"))
    # A group holds one value for each replicate.
    found = each.groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 0, F.col("_d"))).alias("difference"),
        F.percentile(again, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ends"),
        F.stddev_samp(again).alias("std_error"),
        F.count(again).alias("replicates"),
    )
    low, high = F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1))
    return found.select(
        *by, "difference", low.alias("low"), high.alias("high"), "std_error", "replicates",
        ((low > 0) | (high < 0)).alias("significant"),
    )
