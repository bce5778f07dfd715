"""A/B tests: sessions, sizing, group summaries and significance.

Every test first reduces the data to counts or moments per group; the statistic is then
an expression over one row. Two-sided p-values use the normal tail, and for Welch's
statistic that of Student's distribution. Null and NaN values are no observations, and
rows without a user belong to no unit. Without a statistic there is no verdict either:
``significant`` and ``p_value`` are null.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import day, known, micros, number, ratio, student_tail, two_sided_p
from .distribution import bucket_count, with_bucket


def critical_value(alpha: float) -> float:
    """Normal quantile a two-sided statistic must reach."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def verdict(df: DataFrame, statistic: str, alpha: float, freedom: str | None = None) -> DataFrame:
    """Add the p-value of a statistic and whether it is significant at ``alpha``.

    With ``freedom`` the statistic has Student's distribution of so many degrees, else
    the normal one.
    """
    if freedom:
        tested = df.withColumn("p_value", student_tail(F.col(statistic), F.col(freedom)))
        return tested.withColumn("significant", F.col("p_value") <= alpha)
    value = known(F.col(statistic))
    return df.withColumns(
        {"significant": F.abs(value) >= critical_value(alpha), "p_value": two_sided_p(value)}
    )


def sessions(
    df: DataFrame,
    user: str,
    ts: str,
    gap_seconds: int,
    counts: dict[str, Column],
    keep: list[str] | None = None,
) -> DataFrame:
    """Sessions of each user: a pause of at least the gap starts a new one.

    ``counts`` are conditions whose rows are counted per session; ``keep`` are columns
    fixed for a user, such as the test group. Actions without a user make no session.

    Two actions in the same gap-wide cell of time always share a session. So actions are
    first added up per user and cell, on the map side too, and the window that joins
    cells into sessions holds a user's cells, whose number the calendar bounds, rather
    than all of the user's actions.
    """
    gap = gap_seconds * 1_000_000
    who = [user, *(keep or [])]
    cells = (
        df.filter(F.col(user).isNotNull())
        .withColumn("_at", micros(df, ts))
        .groupBy(*who, F.floor(F.col("_at") / F.lit(gap)).alias("_cell"))
        .agg(
            F.min("_at").alias("_from"),
            F.max("_at").alias("_to"),
            F.min(ts).alias("_started"),
            F.max(ts).alias("_ended"),
            F.count("*").alias("_actions"),
            *[F.count_if(c).alias(n) for n, c in counts.items()],
        )
    )
    history = Window.partitionBy(*who).orderBy("_cell")
    pause = F.col("_from") - F.lag("_to").over(history)
    return (
        cells.withColumn("_new", F.when(pause < gap, 0).otherwise(1))
        .withColumn("session_no", F.sum("_new").over(history))
        .groupBy(*who, "session_no")
        .agg(
            F.min("_started").alias("started"),
            F.max("_ended").alias("ended"),
            F.sum("_actions").alias("actions"),
            *[F.sum(n).alias(n) for n in counts],
        )
    )


def sample_size(
    df: DataFrame,
    success: str,
    mde: float,
    alpha: float = 0.05,
    power: float = 0.8,
    pooled: bool = True,
) -> DataFrame:
    """Units per group needed to see the baseline share rise by ``mde`` (absolute).

    The baseline is the share of successes in ``df``. Two-sided two-proportion test;
    under the null hypothesis the variance is pooled, or else that of the alternative.
    A target outside (0, 1) cannot be tested: ``n_per_group`` is null.
    """
    if not mde:
        raise ValueError("the effect to be seen must not be zero")
    z_alpha, z_power = critical_value(alpha), NormalDist().inv_cdf(power)
    p1, p2 = F.col("baseline"), F.col("target")
    mid = (p1 + p2) / 2
    alternative = F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    null = F.sqrt(2 * mid * (1 - mid)) if pooled else alternative
    needed = F.pow((z_alpha * null + z_power * alternative) / mde, 2)
    return (
        df.agg(ratio(F.count_if(success), F.count(success)).alias("baseline"))
        .withColumn("target", p1 + mde)
        .withColumn("n_per_group", F.when((p2 > 0) & (p2 < 1), F.ceil(needed)))
    )


def duration(
    required: DataFrame, activity: DataFrame, user: str, ts: str, groups: int = 2
) -> DataFrame:
    """Days until enough users have come: needed users over mean daily new users.

    Activity without a user is left out.

    ``required`` is the one row of ``sample_size``. A user is new on the first day of
    activity; the mean runs over all calendar days of the data, also those without one.
    """
    per_user = activity.filter(F.col(user).isNotNull()).groupBy(user).agg(
        F.min(day(ts)).alias("_first"), F.max(day(ts)).alias("_last")
    )
    return (
        per_user.agg(
            F.count(user).alias("users"),
            (F.date_diff(F.max("_last"), F.min("_first")) + 1).alias("observed_days"),
        )
        .withColumn("daily_new_users", ratio(F.col("users"), F.col("observed_days")))
        .withColumn("n_required", required.select("n_per_group").scalar() * groups)
        .withColumn("days", F.ceil(ratio(F.col("n_required"), F.col("daily_new_users"))))
    )


def group_counts(
    df: DataFrame, group: str, user: str, registrations: str, page_views: str
) -> DataFrame:
    """Users, sessions, registrations and page views of each group."""
    return df.groupBy(group).agg(
        F.count_distinct(user).alias("users"),
        F.count("*").alias("sessions"),
        F.sum(registrations).alias("registrations"),
        F.sum(page_views).alias("page_views"),
    )


def success_share(df: DataFrame, group: str, success: str) -> DataFrame:
    """Sessions with an outcome, successful ones and their share in each group."""
    return (
        df.filter(F.col(success).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("sessions"), F.count_if(success).alias("successes"))
        .withColumn("share", ratio(F.col("successes"), F.col("sessions")))
    )


def two_proportion_z(
    df: DataFrame,
    group: str,
    success: str,
    a: object,
    b: object,
    alpha: float = 0.05,
    cluster: str | None = None,
) -> DataFrame:
    """Test of the difference in success shares, ``b`` minus ``a``; one row.

    By default sessions count as independent. ``cluster`` names the user column when
    they are not: the variance then comes from each user's sums by the delta method.
    Rows without an outcome are left out, and rows without a user where users count.
    """
    df = df.filter(F.col(success).isNotNull())
    if cluster is not None:
        df = df.filter(F.col(cluster).isNotNull())
    if cluster is None:
        units = df.select(
            F.col(group).alias("_g"), F.col(success).cast("bigint").alias("_s"), F.lit(1).alias("_n")
        )
    else:
        units = df.groupBy(F.col(group).alias("_g"), cluster).agg(
            F.count_if(success).alias("_s"), F.count("*").alias("_n")
        )
    of = lambda g, c: F.when(F.col("_g") == g, F.col(c))
    aggs = []
    for name, g in (("a", a), ("b", b)):
        s, n = of(g, "_s"), of(g, "_n")
        aggs += [F.sum(n).alias(f"n_{name}"), F.sum(s).alias(f"successes_{name}")]
        if cluster is not None:
            aggs += [
                F.count(n).alias(f"_k_{name}"),
                F.var_samp(s).alias(f"_vs_{name}"),
                F.var_samp(n).alias(f"_vn_{name}"),
                F.covar_samp(s.cast("double"), n.cast("double")).alias(f"_c_{name}"),
            ]
    row = units.agg(*aggs).withColumns(
        {f"share_{g}": ratio(F.col(f"successes_{g}"), F.col(f"n_{g}")) for g in "ab"}
    )
    if cluster is None:
        pooled = ratio(
            F.col("successes_a") + F.col("successes_b"), F.col("n_a") + F.col("n_b")
        )
        variance = pooled * (1 - pooled) * (ratio(F.lit(1), F.col("n_a")) + ratio(F.lit(1), F.col("n_b")))
    else:
        # Var(sum s / sum n) = k / (sum n)^2 * (Var s - 2 r Cov(s, n) + r^2 Var n)
        def part(g: str) -> Column:
            r = F.col(f"share_{g}")
            spread = F.col(f"_vs_{g}") - 2 * r * F.col(f"_c_{g}") + r * r * F.col(f"_vn_{g}")
            n = F.col(f"n_{g}").cast("double")
            return ratio(F.col(f"_k_{g}") * spread, n * n)

        variance = part("a") + part("b")
    tested = row.withColumn("difference", F.col("share_b") - F.col("share_a")).withColumn(
        "z", ratio(F.col("difference"), F.sqrt(variance))
    )
    return verdict(tested.drop(*[c for c in tested.columns if c.startswith("_")]), "z", alpha)


def welch(
    df: DataFrame, group: str, x: str, a: object, b: object, alpha: float = 0.05
) -> DataFrame:
    """Welch's test of the difference in means, ``b`` minus ``a``; one row.

    Rows must be independent units. Without variance in both groups the statistic is null.
    """
    value = number(df, x).cast("double")
    aggs = []
    for name, g in (("a", a), ("b", b)):
        of = F.when(F.col(group) == g, value)
        aggs += [
            F.count(of).alias(f"n_{name}"),
            F.avg(of).alias(f"mean_{name}"),
            F.var_samp(of).alias(f"var_{name}"),
        ]
    error = {g: ratio(F.col(f"var_{g}"), F.col(f"n_{g}")) for g in "ab"}
    total = error["a"] + error["b"]
    freedom = ratio(
        total * total,
        ratio(error["a"] * error["a"], F.col("n_a") - 1)
        + ratio(error["b"] * error["b"], F.col("n_b") - 1),
    )
    tested = df.agg(*aggs).withColumns(
        {
            "difference": F.col("mean_b") - F.col("mean_a"),
            "t": ratio(F.col("mean_b") - F.col("mean_a"), F.sqrt(total)),
            "df": freedom,
        }
    )
    return verdict(tested, "t", alpha, "df")


def sessions_per_user(
    df: DataFrame, group: str, user: str, a: object, b: object, alpha: float = 0.05
) -> DataFrame:
    """Mean sessions per user in each group and Welch's test of the difference; one row.

    Sessions without a user are left out.
    """
    per_user = df.filter(F.col(user).isNotNull()).groupBy(group, user).agg(F.count("*").alias("_sessions"))
    return welch(per_user, group, "_sessions", a, b, alpha)


def mann_whitney(
    df: DataFrame, group: str, x: str, a: object, b: object, alpha: float = 0.05, buckets: int | None = None
) -> DataFrame:
    """Mann-Whitney test with tie correction; ``u`` counts pairs where ``a`` is greater.

    Equal values are counted first, the distinct ones are spread over buckets of the
    value range, and only the bucket totals are added up in one place.
    """
    freq = (
        df.filter(number(df, x).isNotNull() & F.col(group).isin(a, b))
        .groupBy(F.col(x).alias("_v"))
        .agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    )
    running = (
        Window.partitionBy("_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    smaller_b = F.sum("_b").over(running) - F.col("_b")
    tied = (F.col("_a") + F.col("_b")).cast("double")
    buckets = (
        with_bucket(freq, "_v", buckets or bucket_count(df))
        .withColumn("_wins", F.col("_a").cast("double") * (smaller_b + F.col("_b") / 2))
        .groupBy("_bucket")
        .agg(
            F.sum("_wins").alias("_wins"),
            F.sum("_a").alias("_a"),
            F.sum("_b").alias("_b"),
            F.sum(tied * tied * tied - tied).alias("_ties"),
        )
    )
    # One row per bucket.
    order = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    lower_b = F.sum("_b").over(order) - F.col("_b")
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    variance = n_a * n_b / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1)))
    tested = (
        buckets.withColumn("_wins", F.col("_wins") + F.col("_a").cast("double") * lower_b)
        .agg(
            F.sum("_a").alias("n_a"),
            F.sum("_b").alias("n_b"),
            F.sum("_wins").alias("u"),
            F.sum("_ties").alias("_ties"),
        )
        .withColumn("z", ratio(F.col("u") - n_a * n_b / 2, F.sqrt(variance)))
        .drop("_ties")
    )
    return verdict(tested, "z", alpha)


def srm(
    df: DataFrame, group: str, user: str, a: object, b: object, share_a: float = 0.5,
    alpha: float = 0.05,
) -> DataFrame:
    """Chi-square check that users were split as planned between two groups; one row.

    Rows without a user are left out.
    """
    users = df.filter(F.col(user).isNotNull()).select(group, user).distinct()
    expected_a = (F.col("users_a") + F.col("users_b")) * share_a
    expected_b = (F.col("users_a") + F.col("users_b")) * (1 - share_a)
    chi2 = ratio(F.pow(F.col("users_a") - expected_a, 2), expected_a) + ratio(
        F.pow(F.col("users_b") - expected_b, 2), expected_b
    )
    row = users.agg(
        F.count_if(F.col(group) == a).alias("users_a"),
        F.count_if(F.col(group) == b).alias("users_b"),
    ).withColumn("chi2", chi2)
    # With two groups the root of chi-square is a normal statistic.
    return verdict(row.withColumn("_root", F.sqrt("chi2")), "_root", alpha).drop("_root")


def overlap(df: DataFrame, group: str, user: str) -> DataFrame:
    """Users, those seen in more than one group, and their share; one row.

    Rows without a user are left out.
    """
    per_user = df.filter(F.col(user).isNotNull()).groupBy(user).agg((F.min(group) != F.max(group)).alias("_both"))
    return per_user.agg(
        F.count("*").alias("users"), F.count_if("_both").alias("in_several_groups")
    ).withColumn("share", ratio(F.col("in_several_groups"), F.col("users")))


def exclusive(df: DataFrame, group: str, user: str) -> DataFrame:
    """Rows of users seen in one group only, as independent groups require.

    Only the users of several groups are joined, who are few; ``overlap`` counts them.
    Rows without a user or group are left out.
    """
    rows = df.filter(F.col(user).isNotNull() & F.col(group).isNotNull())
    per_user = rows.groupBy(user).agg((F.min(group) != F.max(group)).alias("_several"))
    return rows.join(per_user.filter("_several").select(user), user, "left_anti").select(*df.columns)
