"""Summaries that are stored by day and merged later: quantiles and audiences.

A state table has one small row per group and day, made in one pass over the rows. Longer
periods, larger groups and overlaps come from the states alone, within a stated error.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day, number, ratio

# Size of a quantile sketch, and the rank error that it keeps below with 99 % certainty.
SIZE = 400
RANK_ERROR = 0.007
# Binary logarithm of the entries of an audience sketch.
LG_ENTRIES = 12


def value_state(df: DataFrame, by: list[str], ts: str, value: str, size: int = SIZE) -> DataFrame:
    """Per group and day the number of known values, their least and greatest and a sketch."""
    x = number(df, value).cast("double")
    return (
        df.filter(x.isNotNull())
        .groupBy(*by, day(ts).alias("day"))
        .agg(
            F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("greatest"),
            F.kll_sketch_agg_double(x, size).alias("sketch"),
        )
    )


def _period(unit: str | None) -> list[Column]:
    if unit is None:
        return []
    return [(F.col("day") if unit == "day" else F.trunc("day", unit)).alias("period")]


def quantiles_of(state: DataFrame, by: list[str], probs: dict[str, float], unit: str | None = None, size: int = SIZE) -> DataFrame:
    """Quantiles of each group, and of each week, month or other unit, from daily states.

    The columns are ``n``, ``least``, ``greatest`` and one for each name in ``probs``. A
    quantile is a value whose rank share is within ``RANK_ERROR`` of that asked for.
    """
    merged = state.groupBy(*by, *_period(unit)).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch", size).alias("_sketch"),
    )
    found = {name: F.kll_sketch_get_quantile_double("_sketch", F.lit(p).cast("double")) for name, p in probs.items()}
    return merged.withColumns(found).drop("_sketch")


def box_of(state: DataFrame, by: list[str], unit: str | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles and fences from daily states; ``*_beyond`` tells that values lie outside."""
    found = quantiles_of(state, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, unit)
    spread = k * (F.col("q3") - F.col("q1"))
    fenced = found.withColumns({"fence_low": F.col("q1") - spread, "fence_high": F.col("q3") + spread})
    return fenced.withColumns(
        {"low_beyond": F.col("least") < F.col("fence_low"), "high_beyond": F.col("greatest") > F.col("fence_high")}
    )


def audience_state(df: DataFrame, by: list[str], ts: str, user: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Per group and day a theta sketch of the users. Rows without a user are left out."""
    rows = df.filter(F.col(user).isNotNull())
    return rows.groupBy(*by, day(ts).alias("day")).agg(
        F.theta_sketch_agg(F.xxhash64(user), lg_entries).alias("sketch")
    )


def audience_overlap(
    state: DataFrame, segment: str, pairs: list[tuple[object, object]], lg_entries: int = LG_ENTRIES
) -> DataFrame:
    """Users of each of two segments, of both, of one alone and of either, for each pair.

    Sketches of the days are merged per segment in one pass; intersection and difference
    are those of the merged sketches. The error of every count is a share of ``either``:
    2 ** (-lg_entries / 2) at one standard deviation, and none up to 2 ** lg_entries users.
    ``jaccard`` is both over either.
    """
    names = list(dict.fromkeys(chain.from_iterable(pairs)))
    of = {name: f"_s{i}" for i, name in enumerate(names)}
    merged = state.agg(
        *[F.theta_union_agg(F.when(F.col(segment) == name, F.col("sketch")), lg_entries).alias(c) for name, c in of.items()]
    )
    size = lambda c: F.theta_sketch_estimate(c)

    def row(a: object, b: object) -> Column:
        x, y = F.col(of[a]), F.col(of[b])
        both, either = F.theta_intersection(x, y), F.theta_union(x, y, lg_entries)
        counts = {
            "users_a": size(x), "users_b": size(y), "both": size(both), "only_a": size(F.theta_difference(x, y)),
            "only_b": size(F.theta_difference(y, x)), "either": size(either),
        }
        return F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), *[c.alias(n) for n, c in counts.items()],
            ratio(counts["both"], counts["either"]).alias("jaccard"),
        )

    return merged.select(F.inline(F.array(*[row(a, b) for a, b in pairs])))
