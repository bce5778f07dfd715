"""Order statistics and joins that hold when one group owns much of the data.

Spark's exact ``percentile`` and ``mode`` keep every distinct value of a group in one
buffer, and a window over a group sorts it in one task. The operators here count equal
values first (combined on the map side) and spread the distinct values of every group
over buckets of the value range, so that no task holds a whole group.

Bucket edges come from the distinct values with the smallest hashes: a uniform sample of
bounded size that is the same on every evaluation, so a recomputed task agrees with the
rest. Group keys are compared null-safely, which keeps null groups and also stops the
optimiser from adding filters that would make the shared shuffle differ by branch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import known, number
from ..sources import materialise

# Samples per bucket edge, which evens out bucket sizes.
OVERSAMPLING = 8


def bucket_count(df: DataFrame, least: int = 64) -> int:
    """Buckets of the value range: as many as the session's shuffle partitions.

    The operators that use buckets take another number as an argument.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, partitions)


def match(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    return reduce(lambda a, b: a & b, pairs)


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join that keeps the left key columns only."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    joined = left.join(renamed, match(on, [f"_right_{k}" for k in on]), how)
    return joined.drop(*[f"_right_{k}" for k in on])


def combine(by: list[str], *parts: DataFrame) -> DataFrame:
    """Put tables with at most one row per group side by side, null groups included."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in union.columns if c not in by]
    return union.groupBy(*by).agg(*[F.max(c).alias(c) for c in rest])


def attach(
    df: DataFrame, groups: DataFrame, on: list[str], weight: str | None = None, how: str = "inner"
) -> DataFrame:
    """Join a table of group statistics to the rows of those groups (null-safe).

    ``groups`` is written once, so Spark knows its size in bytes: it broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and else shuffles both sides and splits
    skewed keys. ``weight`` names the row count of each group; it is not added. With
    ``how="left"`` rows whose group has no statistics stay.
    """
    return join_on(df, materialise(groups).drop(*[weight] if weight else []), on, how)


def with_bucket(freq: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, which grows with ``value`` and is the same for equal values."""
    step = OVERSAMPLING
    # Rows fall into classes by hash and each class gives its row of least hash. All
    # columns are hashed, so that this branch reads the same shuffle as the result.
    sample = (
        freq.select(value, F.xxhash64(*freq.columns).alias("_h"))
        .groupBy(F.pmod("_h", F.lit(buckets * step)))
        .agg(F.min_by(value, "_h").alias(value))
    )
    edges = sample.agg(
        F.expr(f"filter(array_sort(collect_list({value})), (x, i) -> i % {step} = {step - 1})")
    )
    # Binary search for the number of edges below the value; past the end is no edge.
    halves = ", ".join(str(2**i) for i in reversed(range(buckets.bit_length())))
    below = f"aggregate(array({halves}), 0, (p, s) -> if(get(_e, p + s - 1) < {value}, p + s, p))"
    return freq.select("*", edges.scalar().alias("_e")).selectExpr(
        *freq.columns, f"{below} AS _bucket"
    )


def by_bucket(
    freq: DataFrame, by: list[str], value: str, weight: str, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows spread by group and bucket, and the place of each bucket in its group.

    Both come from one shuffle by ``_key``, a group's keys and the bucket in a struct: it
    is never null itself, so groups with null keys join like others. The second table has
    one row per group and bucket with ``_before``, the weight in lower buckets, ``_here``,
    its own, and ``_size``, that of the whole group.
    """
    spread = (
        with_bucket(freq, value, buckets or bucket_count(freq))
        .select(F.struct(*by, "_bucket").alias("_key"), value, weight)
        .repartition("_key")
    )
    totals = (
        spread.groupBy("_key")
        # The mark keeps the value in this branch, so that the shuffle is the same.
        .agg(F.sum(weight).alias("_here"), F.bit_xor(F.xxhash64(value)).alias("_mark"))
        .filter(F.col("_mark").isNotNull())
    )
    # At most one row per bucket in each window partition.
    group = Window.partitionBy(*[F.col(f"_key.{k}") for k in by] or [F.lit(0)])
    return spread, totals.select(
        "_key",
        (F.sum("_here").over(group.orderBy("_key._bucket")) - F.col("_here")).alias("_before"),
        F.sum("_here").over(group).alias("_size"),
        "_here",
    )


def running_weight(value: str, weight: str) -> Column:
    """Weight of the values up to this one inside its bucket."""
    window = Window.partitionBy("_key").orderBy(F.col(value).asc_nulls_first())
    return F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def quantiles(
    df: DataFrame,
    by: list[str],
    columns: dict[str, Column | str],
    probs: dict[str, float] | None = None,
    exact: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Quantiles of several columns per group, linearly interpolated, null and NaN ignored.

    Result columns are ``<name><suffix>`` for each ``columns`` name and ``probs`` suffix;
    the default is the median under the plain name. Groups without any value are absent.
    ``exact=False`` uses bounded-size sketches in one shuffle (returns existing values).
    """
    probs = probs or {"": 0.5}
    cols = {n: known((F.col(c) if isinstance(c, str) else c).cast("double")) for n, c in columns.items()}
    if not exact:
        return df.groupBy(*by).agg(
            *[
                F.percentile_approx(c, p, 10_000).alias(n + s)
                for n, c in cols.items()
                for s, p in probs.items()
            ]
        )
    if len(cols) == 1:
        (name, col), = cols.items()
        long = df.select(*by, F.lit(name).alias("_col"), col.alias("_v"))
    else:
        entries = [F.struct(F.lit(n).alias("_col"), c.alias("_v")) for n, c in cols.items()]
        long = df.select(*by, F.explode(F.array(*entries)).alias("_x")).select(*by, "_x.*")
    keys = [*by, "_col"]
    freq = long.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    spread, places = by_bucket(freq, keys, "_v", "_n", buckets)

    # 0-based ranks of the two neighbours each quantile lies between.
    low = {s: F.floor((F.col("_size") - 1) * p) for s, p in probs.items()}
    high = {s: F.ceil((F.col("_size") - 1) * p) for s, p in probs.items()}
    ranks = [*low.values(), *high.values()]
    holds = lambda rank, first, behind: (rank >= first) & (rank < behind)
    wanted = places.filter(
        reduce(
            lambda a, b: a | b,
            [holds(r, F.col("_before"), F.col("_before") + F.col("_here")) for r in ranks],
        )
    )
    # Only buckets that hold a wanted rank are sorted.
    rows = spread.join(wanted, "_key").select(
        *[F.col(f"_key.{k}").alias(k) for k in keys],
        "_v",
        "_n",
        "_size",
        (F.col("_before") + running_weight("_v", "_n")).alias("_behind"),
    )
    first = F.col("_behind") - F.col("_n")
    pick = lambda name, rank: F.max(
        F.when((F.col("_col") == name) & holds(rank, first, F.col("_behind")), F.col("_v"))
    )
    share = lambda s, p: (F.col("_size") - 1) * p - low[s]
    aggs = []
    for name in cols:
        for s, p in probs.items():
            aggs += [
                pick(name, low[s]).alias(f"_lo_{name}{s}"),
                pick(name, high[s]).alias(f"_hi_{name}{s}"),
                F.max(F.when(F.col("_col") == name, share(s, p))).alias(f"_at_{name}{s}"),
            ]
    names = [n + s for n in cols for s in probs]
    # A quantile on a value is that value, also when the next one is infinite.
    between = lambda n: F.when(F.col(f"_at_{n}") == 0, F.col(f"_lo_{n}")).otherwise(
        F.col(f"_lo_{n}") * (1 - F.col(f"_at_{n}")) + F.col(f"_hi_{n}") * F.col(f"_at_{n}")
    )
    return rows.groupBy(*by).agg(*aggs).select(*by, *[between(n).alias(n) for n in names])


def modes(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Most frequent value of each text column per group; of tied values the smallest."""
    entries = [F.struct(F.lit(c).alias("_col"), F.col(c).alias("_v")) for c in columns]
    long = df.select(*by, F.explode(F.array(*entries)).alias("_x")).select(*by, "_x.*")
    counts = long.filter(F.col("_v").isNotNull()).groupBy(*by, "_col", "_v").agg(
        F.count("*").alias("_n")
    )
    best = lambda c: F.min_by(
        F.when(F.col("_col") == c, F.col("_v")),
        F.when(F.col("_col") == c, F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))),
    )
    return counts.groupBy(*by).agg(*[best(c).alias(c) for c in columns])


def rank_rows(
    df: DataFrame, measure: str, name: str, by: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """Add the rank (1, 2, 2, 4) of each row by falling ``measure``, as ``name``.

    For ranking without a partition, or within partitions that are not known to be
    small. Null and NaN measures share the last place. ``df`` is read several times, so it
    is written once first.
    """
    by = by or []
    rows = materialise(df.withColumn("_measure", number(df, measure)))
    freq = rows.groupBy(*by, "_measure").agg(F.count("*").alias("_n"))
    spread, places = by_bucket(freq, by, "_measure", "_n", buckets)
    upto = F.col("_before") + running_weight("_measure", "_n")
    ranks = spread.join(places, "_key").select(
        *[F.col(f"_key.{k}").alias(k) for k in by],
        "_measure",
        (F.col("_size") - upto + 1).alias(name),
        "_n",
    )
    return attach(rows, ranks, [*by, "_measure"], "_n").drop("_measure")


def rank_correlation(
    df: DataFrame, x: str, y: str, by: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """Spearman's correlation of two measures per group, tied values at their mean rank.

    Null and NaN make a pair incomplete; only complete pairs count. Equal pairs are added
    up first. Each measure is ranked by buckets of its value range, and the ranks are
    joined to the different pairs, so neither a large group nor a frequent value is ever
    in one task or in one window. Result: ``by``, ``n`` and ``rho``, null where a measure
    has one value only.
    """
    by = by or []
    a, b = (number(df, c).cast("double") for c in (x, y))
    pairs = df.select(*by, a.alias("_x"), b.alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    pairs = materialise(pairs.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w")))
    placed = pairs
    for c in ("_x", "_y"):
        freq = pairs.groupBy(*by, c).agg(F.sum("_w").alias("_n"))
        spread, places = by_bucket(freq, by, c, "_n", buckets)
        # Twice the mean rank less the mean of all ranks: a whole number, zero on average.
        upto = F.col("_before") + running_weight(c, "_n")
        ranks = spread.join(places, "_key").select(
            *[F.col(f"_key.{k}").alias(k) for k in by],
            c,
            (2 * upto - F.col("_n") - F.col("_size")).cast("double").alias(f"_r{c}"),
        )
        placed = attach(placed, ranks, [*by, c])
    r, s, w = F.col("_r_x"), F.col("_r_y"), F.col("_w")
    sums = placed.groupBy(*by).agg(
        F.sum("_w").alias("n"), F.sum(w * r * s).alias("_rs"), F.sum(w * r * r).alias("_rr"), F.sum(w * s * s).alias("_ss")
    )
    spread = F.sqrt("_rr") * F.sqrt("_ss")
    return sums.select(*by, "n", F.try_divide(F.col("_rs"), F.when(spread > 0, spread)).alias("rho"))


def share_of_total(df: DataFrame, measure: str, name: str = "share") -> DataFrame:
    """Add each row's share of the table's total. ``df`` is an aggregated table."""
    total = df.agg(F.sum(measure))
    return df.withColumn(name, F.try_divide(F.col(measure).cast("double"), total.scalar().cast("double")))


def share_within(df: DataFrame, measure: str, within: list[str], name: str = "share") -> DataFrame:
    """Add each row's share of its group's total. ``df`` is an aggregated table.

    The totals are aggregated and joined, so no group has to fit one task.
    """
    totals = df.groupBy(*within).agg(F.sum(measure).alias("_total"))
    joined = join_on(df, totals, within)
    return joined.withColumn(
        name, F.try_divide(F.col(measure).cast("double"), F.col("_total").cast("double"))
    ).drop("_total")
