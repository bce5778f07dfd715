"""Conference talks: topics, reactions, speakers and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import day, mean
from .prepare import explode_topics
from .summary import counts_with_share, top_k


def topic_counts(df: DataFrame, topics: str, separator: str | None = None) -> DataFrame:
    """Talks per topic and their share of all topic mentions."""
    return counts_with_share(explode_topics(df.select(topics), topics, separator), ["topic"], "talks")


def reaction_by_topic(
    df: DataFrame,
    topics: str,
    reaction: str,
    reactions: list[str],
    separator: str | None = None,
) -> DataFrame:
    """Talks per topic with one column for each listed reaction, 0 where there is none."""
    rows = explode_topics(df.select(topics, reaction), topics, separator)
    return rows.groupBy("topic").agg(
        F.count("*").alias("talks"),
        *[F.count_if(F.col(reaction) == r).alias(f"reaction_{r.lower()}") for r in reactions],
    )


def top_speakers(
    df: DataFrame, speaker: str, score: str, k: int, min_talks: int
) -> DataFrame:
    """The ``k`` speakers with the best mean reaction among those with enough talks."""
    speakers = df.groupBy(speaker).agg(
        F.count("*").alias("talks"), mean(df, score).alias("mean_score")
    )
    return top_k(speakers.filter(F.col("talks") >= min_talks), "mean_score", k, [speaker])


def popular_time(df: DataFrame, ts: str, unit: str, conference: str) -> DataFrame:
    """Conferences and talks per month (1-12), weekday (1 = Monday) or hour, with rank.

    The ranking window holds one row per month, weekday or hour.
    """
    part = {
        "month": F.month(day(ts)),
        "weekday": F.weekday(day(ts)) + 1,
        "hour": F.hour(ts),
    }[unit]
    counts = df.groupBy(part.alias(unit)).agg(
        F.count_distinct(conference).alias("conferences"), F.count("*").alias("talks")
    )
    order = Window.partitionBy(F.lit(unit)).orderBy(F.col("conferences").desc())
    return counts.withColumn("place", F.rank().over(order))
