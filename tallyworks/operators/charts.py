"""The numbers behind charts and dashboards, reduced from tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bin_index, hash32, known, number, ratio
from .distribution import attach, quantiles, share_of_total

# Binary logarithm of the registers of a distinct count.
LG_K = 12


def histogram(
    df: DataFrame, x: str, low: float, high: float, bins: int, by: list[str] | None = None
) -> DataFrame:
    """Rows per equal-width bin, empty bins included; values outside go to the end bins."""
    by = by or []
    position = bin_index(F.col(x), F.lit(low), F.lit(high), bins)
    counts = (
        df.filter(known(F.col(x)).isNotNull())
        .groupBy(*by, position.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    # A group's map has no more entries than there are bins.
    filled = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_filled")
    )
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    width = (high - low) / bins
    return filled.withColumn("bin", every_bin).select(
        *by,
        "bin",
        F.coalesce(F.col("_filled")[F.col("bin")], F.lit(0)).alias("n"),
        (low + F.col("bin") * F.lit(width)).alias("bin_from"),
    )


def boxplot(df: DataFrame, x: str, by: list[str], k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values within ``k`` interquartile ranges), outliers.

    Null and NaN are left out. Whiskers are searched among counts of equal values, added up on the map side.
    """
    value = F.col(x).cast("double")
    df = df.filter(known(value).isNotNull())
    quartiles = quantiles(df, by, {"q": x}, {"1": 0.25, "2": 0.5, "3": 0.75})
    freq = (
        df.groupBy(*by, value.alias("_x"))
        .agg(F.count("*").alias("_n"))
    )
    spread = k * (F.col("q3") - F.col("q1"))
    fences = quartiles.withColumns({"_low": F.col("q1") - spread, "_high": F.col("q3") + spread})
    if by:
        fenced = attach(freq, fences, by)
    else:
        added = fences.select(F.struct("*")).scalar()
        fenced = freq.withColumn("_f", added).select("*", "_f.*").drop("_f")
    inside = F.col("_x").between(F.col("_low"), F.col("_high"))
    return fenced.groupBy(*by).agg(
        *[F.max(q).alias(q) for q in ("q1", "q2", "q3")],
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
        F.sum("_n").alias("n"),
    )


def scatter_bins(
    df: DataFrame,
    x: str,
    y: str,
    nx: int,
    ny: int,
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Points per cell of a grid. Ranges not given are those of the data.

    A point with a null or NaN is none.
    """
    points = df.filter(number(df, x).isNotNull() & number(df, y).isNotNull()).select(x, y)
    if x_range and y_range:
        xl, xh, yl, yh = (F.lit(v) for v in (*x_range, *y_range))
        placed = points
    else:
        bounds = points.agg(
            F.struct(
                F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh")
            )
        )
        placed = points.withColumn("_b", bounds.scalar())
        xl, xh = (F.lit(v) for v in x_range) if x_range else (F.col("_b.xl"), F.col("_b.xh"))
        yl, yh = (F.lit(v) for v in y_range) if y_range else (F.col("_b.yl"), F.col("_b.yh"))
    return placed.groupBy(
        bin_index(F.col(x), xl, xh, nx).alias("x_bin"), bin_index(F.col(y), yl, yh, ny).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def scatter_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """A fixed number of rows to draw, the same on every run: those of smallest key hash.

    ``key`` are columns of whole numbers. Each task keeps its own ``n`` candidates.
    """
    rest = [c for c in df.columns if c not in key]
    return df.orderBy(hash32(*[F.col(c) for c in key]), *key, *rest).limit(n)


def series(df: DataFrame, x: str, y: str, agg: str) -> DataFrame:
    """One value per category or period for a bar, line or pie chart.

    ``agg`` is count, sum, avg, min or max; counts and sums also get their share. Null and
    NaN are left out; a category of them alone has a null sum, and a null share.
    """
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    values = df.groupBy(x).agg(functions[agg](number(df, y)).alias("value"))
    return share_of_total(values, "value") if agg in ("count", "sum") else values


def dashboard_state(
    df: DataFrame, dims: list[str], sums: dict[str, Column], distinct: dict[str, Column] | None = None, lg_k: int = LG_K
) -> DataFrame:
    """What a dashboard needs of the rows: one row per combination of dimensions.

    Counts and sums, and a sketch of each counted value, nulls ignored. States of other
    days or tables can be appended to a stored one; ``dashboard_of`` adds them up.
    """
    sketches = {
        name: F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), lg_k) for name, c in (distinct or {}).items()
    }
    return df.groupBy(*dims).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()],
        *[c.alias(name) for name, c in sketches.items()],
    )


def dashboard_of(
    state: DataFrame,
    dims: list[str],
    sums: list[str],
    distinct: list[str] | None = None,
    subtotals: str = "cube",
    ratios: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """The dashboard of a stored state. Distinct counts are estimates from merged sketches.

    Their relative error is 0.83 / sqrt(2 ** lg_k) at one standard deviation.
    """
    grouped = state.cube(*dims) if subtotals == "cube" else state.rollup(*dims)
    metrics = grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(c).alias(c) for c in ["n", *sums]],
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct or []],
    )
    return metrics.withColumns({k: ratio(F.col(a), F.col(b)) for k, (a, b) in (ratios or {}).items()})


def dashboard(
    df: DataFrame,
    dims: list[str],
    sums: dict[str, Column],
    subtotals: str = "cube",
    distinct: dict[str, Column] | None = None,
    ratios: dict[str, tuple[str, str]] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Row count and metrics for every combination of dimensions, with subtotals.

    ``distinct`` counts different values, nulls ignored; ``ratios`` divide two of the
    metrics on their own level, null where the divisor is zero. ``level`` is the grouping
    id: bit set = that dimension is summed over. Rows are added up by all dimensions and
    counted values first, so the subtotals multiply groups and not rows; each distinct
    count is shuffled by its values too, so a large total is not left to one task. That
    multiplies the different values by the subtotals and the counts; ``exact=False`` keeps
    a sketch per combination of dimensions instead and merges those, see ``dashboard_of``.
    """
    distinct = distinct or {}
    if not exact:
        return dashboard_of(dashboard_state(df, dims, sums, distinct), dims, [*sums], [*distinct], subtotals, ratios)
    values = {name: f"_distinct_{name}" for name in distinct}
    base = df.groupBy(*dims, *[c.alias(values[name]) for name, c in distinct.items()]).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    grouped = base.cube(*dims) if subtotals == "cube" else base.rollup(*dims)
    metrics = grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(c).alias(c) for c in ["n", *sums]],
        *[F.count_distinct(value).alias(name) for name, value in values.items()],
    )
    return metrics.withColumns({k: ratio(F.col(a), F.col(b)) for k, (a, b) in (ratios or {}).items()})
