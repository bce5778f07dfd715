"""Conference talks on order lines."""

from __future__ import annotations

from ..operators.summary import avg_distinct_per, avg_length
from ..operators.talks import popular_time, reaction_by_topic, top_speakers, topic_counts
from ..operators.tickets import period_start
from .inputs import conferences, talks
from .tables import money, plain, table

MIN_TALKS = 100


def talk_topics(spark, d):
    return plain(topic_counts(talks(spark, d), "topics"))


def talk_reactions(spark, d):
    return plain(reaction_by_topic(talks(spark, d), "topics", "reaction", ["A", "N", "R"]))


def talk_top_speakers(spark, d):
    scored = table(spark, d, "lineitem").select(
        "l_suppkey", money("l_tax", "decimal(4,2)").alias("score")
    )
    return plain(top_speakers(scored, "l_suppkey", "score", 10, MIN_TALKS))


def talk_speakers_per_conf(spark, d):
    # The order key of a line is its conference; no date is needed here.
    given = table(spark, d, "lineitem").withColumnsRenamed(
        {"l_orderkey": "conference", "l_suppkey": "speaker"}
    )
    return plain(avg_distinct_per(given, "conference", "speaker"), {"mean_speakers": 6})


def talk_length(spark, d):
    given = conferences(spark, d)
    return plain(avg_length(given.withColumn("year", period_start("starts", "year")), ["year"], "length"))


def talk_popular_time(spark, d):
    return plain(popular_time(conferences(spark, d), "starts", "weekday", "conference"))


def talk_popular_month(spark, d):
    return plain(popular_time(conferences(spark, d), "starts", "month", "conference"))


QUERIES = {
    "talk_topics": talk_topics,
    "talk_reactions": talk_reactions,
    "talk_top_speakers": talk_top_speakers,
    "talk_speakers_per_conf": talk_speakers_per_conf,
    "talk_length": talk_length,
    "talk_popular_time": talk_popular_time,
    "talk_popular_month": talk_popular_month,
}

_MENTIONS = """
lines AS (SELECT row_number() OVER () AS id, l_partkey, l_returnflag FROM lineitem),
words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS topic FROM part),
mention AS (
  SELECT DISTINCT id, topic, l_returnflag AS reaction
  FROM lines JOIN words ON l_partkey = p_partkey WHERE topic <> ''
)
"""


def _popular(unit: str, part: str) -> str:
    return f"""
WITH counts AS (
  SELECT {part}(o_orderdate)::BIGINT AS {unit}, count(DISTINCT l_orderkey) AS conferences,
         count(*) AS talks
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT *, rank() OVER (ORDER BY conferences DESC) AS place FROM counts"""


SQL = {
    "talk_topics": f"""WITH {_MENTIONS}
SELECT topic, count(*) AS talks, count(*) / sum(count(*)) OVER () AS share
FROM mention GROUP BY topic""",
    "talk_reactions": f"""WITH {_MENTIONS}
SELECT topic, count(*) AS talks, count(*) FILTER (reaction = 'A') AS reaction_a,
       count(*) FILTER (reaction = 'N') AS reaction_n, count(*) FILTER (reaction = 'R') AS reaction_r
FROM mention GROUP BY topic""",
    "talk_top_speakers": f"""
SELECT l_suppkey, count(*) AS talks, sum(l_tax::DECIMAL(4,2))::DOUBLE / count(*) AS mean_score
FROM lineitem GROUP BY l_suppkey HAVING count(*) >= {MIN_TALKS}
ORDER BY mean_score DESC, l_suppkey LIMIT 10""",
    "talk_speakers_per_conf": """
SELECT count(*) AS conferences, round(avg(n), 6) AS mean_speakers
FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)""",
    "talk_length": """
SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year, count(l_quantity) AS n,
       sum(l_quantity::DECIMAL(12,2))::DOUBLE / count(l_quantity) AS mean_length
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "talk_popular_time": _popular("weekday", "isodow"),
    "talk_popular_month": _popular("month", "month"),
}
