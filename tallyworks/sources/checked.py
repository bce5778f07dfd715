"""Writing a prepared data set through a quality gate, and replacing one period of it."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from .tables import load, save

PERIOD = "period"
BROKEN = "broken_rules"


class QualityError(ValueError):
    """Too many rows break a rule; ``shares`` has the share of each rule."""

    def __init__(self, shares: dict[str, float], limits: dict[str, float]):
        self.shares = shares
        over = {name: shares[name] for name, limit in limits.items() if shares[name] > limit}
        super().__init__(f"share of rows above the limit: {over}")


def _folder(spark: SparkSession, path: str):
    """Spark's handle of a folder: its file system and its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, here = _folder(spark, source)
    there = _folder(spark, target)[1]
    files.mkdirs(there.getParent())
    if not files.rename(here, there):
        raise OSError(f"could not move {source} to {target}")


def _drop(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def save_checked(
    df: DataFrame, path: str, rules: dict[str, Column], quarantine: str, limits: dict[str, float] | float = 0.0
) -> dict[str, int]:
    """Write ``df`` and judge the rules in the same pass over the rows.

    ``rules`` are conditions that a row breaks where they are true, as in ``violations``; a
    null outcome is no breach. Rows that break any go to ``quarantine``, in folders by the
    names of the broken rules (column ``broken_rules``, joined by ``+``), all others to
    ``path``. Both are written to a folder beside the target first. Where the share of rows
    that break a rule is above its limit (one for all rules, or by name; a rule not named
    has none), nothing appears at ``path``, the quarantine stays for inspection, and
    ``QualityError`` is raised. Returns ``rows``, ``quarantined`` and the breaches of each
    rule. An existing target or quarantine is an error. The counts come from the write
    itself, where a repeated task counts once.
    """
    if {"rows", "quarantined"} & set(rules):
        raise ValueError("rows and quarantined are names of counts")
    if BROKEN in (c.lower() for c in df.columns):
        raise ValueError(f"{BROKEN} is the column that the gate adds")
    spark = df.sparkSession
    for target in (path, quarantine):
        files, where = _folder(spark, target)
        if files.exists(where):
            raise FileExistsError(target)
    limits = limits if isinstance(limits, dict) else dict.fromkeys(rules, limits)
    # The names of the broken rules, null for a right row.
    names = F.concat_ws("+", *[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    judged = df.withColumn(BROKEN, F.when(names != "", names))
    counts = [F.count_if(broken).alias(f"_{i}") for i, broken in enumerate(rules.values())]
    seen = Observation()
    watched = judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(BROKEN).alias("quarantined"), *counts)
    stage = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    save(watched, stage, [BROKEN])
    found = seen.get
    told = {"rows": found["rows"], "quarantined": found["quarantined"]} | {
        name: found[f"_{i}"] for i, name in enumerate(rules)
    }
    shares = {name: told[name] / told["rows"] if told["rows"] else 0.0 for name in rules}
    refused = any(shares[name] > limit for name, limit in limits.items())
    right = f"{stage}/{BROKEN}=__HIVE_DEFAULT_PARTITION__"
    if refused:
        _drop(spark, right)
    elif told["rows"] > told["quarantined"]:
        _move(spark, right, path)
    else:
        # No row is right, or there is none: the target is there all the same.
        save(spark.createDataFrame([], df.schema), path)
    if told["quarantined"]:
        _move(spark, stage, quarantine)
    else:
        _drop(spark, stage)
    if refused:
        raise QualityError(shares, limits)
    return told


def period_of(ts: Column, unit: str = "month") -> Column:
    """The first day of the period a time falls in."""
    return F.to_date(F.date_trunc(unit, ts))


def save_by_period(df: DataFrame, path: str, ts: str, unit: str = "month") -> None:
    """Write a result in folders by period, which ``replace_period`` can replace alone."""
    save(df.withColumn(PERIOD, period_of(F.col(ts), unit)), path, [PERIOD])


def _whole(first: date, last: date, unit: str) -> bool:
    """Whether the days from first to last are whole periods."""
    after = date.fromordinal(last.toordinal() + 1)
    starts = {
        "day": lambda d: True, "week": lambda d: d.weekday() == 0, "month": lambda d: d.day == 1,
        "year": lambda d: (d.month, d.day) == (1, 1),
    }[unit]
    return first <= last and starts(first) and starts(after)


def replace_period(df: DataFrame, path: str, ts: str, first: str, last: str, unit: str = "month") -> list[str]:
    """Put ``df`` in the place of all saved rows from ``first`` to ``last``, whole periods.

    Only the folders of these periods are touched. A period that had rows and has none
    now ends up empty. A row of ``df`` outside the days is an error and nothing is
    replaced. Returns the periods that ended up empty.
    """
    spark = df.sparkSession
    days = date.fromisoformat(first), date.fromisoformat(last)
    if not _whole(*days, unit):
        raise ValueError(f"{first} to {last} are no whole periods of a {unit}")
    outside = ~F.to_date(F.col(ts)).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    outside = F.coalesce(outside, F.lit(True))
    guard = F.when(outside, F.raise_error(F.lit(f"a row lies outside {first} to {last}")).cast("boolean"))
    rows = df.withColumn(PERIOD, period_of(F.col(ts), unit)).filter(F.coalesce(guard, F.lit(True)))
    seen = Observation()
    rows = rows.observe(seen, F.collect_set(F.col(PERIOD).cast("string")).alias("periods"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
    new = set(seen.get["periods"])
    stale = []
    files, where = _folder(spark, path)
    for status in files.listStatus(where):
        key, _, value = status.getPath().getName().partition("=")
        if key == PERIOD and first <= value <= last and value not in new:
            stale.append(value)
    empty = spark.createDataFrame([], df.schema)
    for value in stale:
        empty.write.mode("overwrite").parquet(f"{path}/{PERIOD}={value}")
    return sorted(stale)


def load_period(
    spark: SparkSession, path: str, schema: StructType | str, ts: str, first: str, last: str, unit: str = "month"
) -> DataFrame:
    """The rows from ``first`` to ``last``; only the folders of their periods are listed."""
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = load(spark, path, StructType([*declared.fields]).add(PERIOD, "date"))
    low, high = (period_of(F.lit(x).cast("timestamp_ntz"), unit) for x in (first, last))
    days = F.to_date(F.col(ts)).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return whole.filter(F.col(PERIOD).between(low, high) & days).drop(PERIOD)
