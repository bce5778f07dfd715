"""Event tickets on the orders and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.distribution import attach
from ..operators.experiment import exclusive, mann_whitney, overlap, welch
from ..operators.tickets import (
    activity_by,
    period_start,
    popularity,
    price_profile,
    seasonality,
    share_change,
)
from ..operators.stored import audience_overlap, audience_state, quantiles_of, value_state
from ..sources import materialise
from .inputs import devices
from .tables import money, plain, sql_p_value, sql_student_tail, table


def ticket_seasonality(spark, d):
    return plain(seasonality(table(spark, d, "orders"), "o_orderdate", "month", "o_custkey"))


def ticket_seasonality_week(spark, d):
    return plain(seasonality(table(spark, d, "orders"), "o_orderdate", "week", "o_custkey"))


def ticket_seasonality_day(spark, d):
    return plain(seasonality(table(spark, d, "events"), "ts", "day", "user_id"))


def ticket_popularity(spark, d):
    return plain(popularity(table(spark, d, "events"), ["event_type"]))


def ticket_popularity_event(spark, d):
    # A single event of the programme is a part; each line is an order for it.
    return plain(popularity(table(spark, d, "lineitem"), ["l_partkey"]))


def ticket_share_change(spark, d):
    return plain(share_change(table(spark, d, "events"), "ts", "week", "event_type"))


def ticket_device_activity(spark, d):
    return plain(activity_by(devices(spark, d), "device", "user_id"))


def ticket_price_profile(spark, d):
    prices = table(spark, d, "events").select(
        "event_type", period_start("ts", "week").alias("period"), money("value").alias("price")
    )
    digits = dict.fromkeys(["stddev_price", "price_q1", "price_median", "price_q3"], 6)
    return plain(price_profile(prices, ["event_type", "period"], "price"), digits)


def _one_device(spark, d):
    return exclusive(devices(spark, d).select("user_id", "device", "value"), "device", "user_id")


_WELCH_DIGITS = dict.fromkeys(
    ["mean_a", "var_a", "mean_b", "var_b", "difference", "t", "df", "p_value"], 6
)


def ticket_device_overlap(spark, d):
    """Users of both devices, whom the device tests exclude."""
    return plain(overlap(devices(spark, d), "device", "user_id"))


def ticket_device_welch(spark, d):
    per_user = _one_device(spark, d).groupBy("device", "user_id").agg(F.count("*").alias("actions"))
    return plain(welch(per_user, "device", "actions", "mobile", "desktop"), _WELCH_DIGITS)


def ticket_device_mwu(spark, d):
    tested = mann_whitney(_one_device(spark, d), "device", "value", "mobile", "desktop")
    return plain(tested, {"z": 6, "p_value": 6})


PROBS = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def ticket_price_stored(spark, d):
    """Weekly price quartiles of each event type from daily sketches."""
    states = materialise(value_state(table(spark, d, "events"), ["event_type"], "ts", "value"))
    return plain(quantiles_of(states, ["event_type"], PROBS, "week"))


def ticket_price_stored_bound(spark, d):
    """Whether the weekly quartiles from daily sketches lie within 2 % of the ranks asked for."""
    events = table(spark, d, "events").select("event_type", "ts", "value")
    states = materialise(value_state(events, ["event_type"], "ts", "value"))
    found = quantiles_of(states, ["event_type"], PROBS, "week")
    keyed = events.withColumn("period", period_start("ts", "week"))
    rows = attach(keyed, found, ["event_type", "period"])
    below = {q: F.count_if(F.col("value") < F.col(q)) for q in PROBS}
    upto = {q: F.count_if(F.col("value") <= F.col(q)) for q in PROBS}
    near = lambda q, p: (below[q] <= (p + 0.02) * F.count("*")) & (upto[q] >= (p - 0.02) * F.count("*"))
    return plain(
        rows.groupBy("event_type", "period").agg(
            F.max("n").alias("n"), F.max("least").alias("least"), F.max("greatest").alias("greatest"),
            *[near(q, p).alias(f"{q}_within_bound") for q, p in PROBS.items()],
        )
    )


_COUNTS = ["users_a", "users_b", "both", "only_a", "only_b", "either"]


def _audience(spark, d):
    states = materialise(audience_state(devices(spark, d), ["device"], "ts", "user_id"))
    return audience_overlap(states, "device", [("mobile", "desktop")])


def ticket_audience(spark, d):
    """Users of both devices from stored daily sketches."""
    return plain(_audience(spark, d))


def ticket_audience_bound(spark, d):
    """The same with exact counts, and whether each estimate lies within five percent of
    all users."""
    seen = devices(spark, d).groupBy("user_id").agg(
        F.max(F.col("device") == "mobile").alias("x"), F.max(F.col("device") == "desktop").alias("y")
    )
    x, y = F.col("x"), F.col("y")
    exact = seen.agg(
        F.count_if(x).alias("users_a"), F.count_if(y).alias("users_b"), F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), F.count_if(x | y).alias("either"),
    )
    estimate = _audience(spark, d).select(F.struct(*_COUNTS))
    both = exact.withColumn("_e", estimate.scalar())
    near = lambda c: F.abs(F.col(f"_e.{c}") - F.col(c)) <= 0.05 * F.col("either")
    return plain(both.select(*_COUNTS, *[near(c).alias(f"{c}_within_bound") for c in _COUNTS]))


QUERIES = {
    "ticket_seasonality": ticket_seasonality,
    "ticket_seasonality_week": ticket_seasonality_week,
    "ticket_seasonality_day": ticket_seasonality_day,
    "ticket_popularity": ticket_popularity,
    "ticket_popularity_event": ticket_popularity_event,
    "ticket_share_change": ticket_share_change,
    "ticket_device_activity": ticket_device_activity,
    "ticket_price_profile": ticket_price_profile,
    "ticket_device_overlap": ticket_device_overlap,
    "ticket_device_welch": ticket_device_welch,
    "ticket_device_mwu": ticket_device_mwu,
    "ticket_price_stored": ticket_price_stored,
    "ticket_price_stored_bound": ticket_price_stored_bound,
    "ticket_audience": ticket_audience,
    "ticket_audience_bound": ticket_audience_bound,
}

_DEVICES = """
device_events AS (
  SELECT *, CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop'
       ELSE CASE WHEN regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 2 = 0 THEN 'mobile'
                 ELSE 'desktop' END END AS device
  FROM events),
one_device AS (
  SELECT * FROM device_events WHERE user_id IN (
    SELECT user_id FROM device_events GROUP BY user_id HAVING count(DISTINCT device) = 1))
"""


def sql_welch(source: str, group: str, x: str, a: str, b: str) -> str:
    """Welch's test over a relation, with the operator's columns."""
    return f"""
moments AS (
  SELECT count({x}) FILTER ({group} = {a}) AS n_a, avg({x}) FILTER ({group} = {a}) AS m_a,
         var_samp({x}) FILTER ({group} = {a}) AS v_a, count({x}) FILTER ({group} = {b}) AS n_b,
         avg({x}) FILTER ({group} = {b}) AS m_b, var_samp({x}) FILTER ({group} = {b}) AS v_b
  FROM {source}),
tested AS (
  SELECT *, (m_b - m_a) / sqrt(v_a / n_a + v_b / n_b) AS t_value,
         (v_a / n_a + v_b / n_b) ^ 2
         / ((v_a / n_a) ^ 2 / (n_a - 1) + (v_b / n_b) ^ 2 / (n_b - 1)) AS freedom
  FROM moments)
SELECT n_a, round(m_a, 6) AS mean_a, round(v_a, 6) AS var_a, n_b, round(m_b, 6) AS mean_b,
       round(v_b, 6) AS var_b, round(m_b - m_a, 6) AS difference, round(t_value, 6) AS t,
       round(freedom, 6) AS df, p <= 0.05 AS significant, round(p, 6) AS p_value
FROM (SELECT *, {sql_student_tail("t_value", "freedom")} AS p FROM tested)"""


SQL = {
    "ticket_price_stored_bound": """
SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, count(value) AS n,
       min(value) AS least, max(value) AS greatest, true AS q1_within_bound,
       true AS q2_within_bound, true AS q3_within_bound
FROM events GROUP BY event_type, date_trunc('week', ts)""",
    "ticket_audience_bound": f"""WITH {_DEVICES}, seen AS (
  SELECT user_id, bool_or(device = 'mobile') AS x, bool_or(device = 'desktop') AS y
  FROM device_events GROUP BY user_id)
SELECT count(*) FILTER (x) AS users_a, count(*) FILTER (y) AS users_b, count(*) FILTER (x AND y) AS "both",
       count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b, count(*) AS either,
       true AS users_a_within_bound, true AS users_b_within_bound, true AS both_within_bound,
       true AS only_a_within_bound, true AS only_b_within_bound, true AS either_within_bound
FROM seen""",
    "ticket_seasonality": """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n,
       count(DISTINCT o_custkey) AS users
FROM orders GROUP BY 1""",
    "ticket_seasonality_week": """
SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n,
       count(DISTINCT o_custkey) AS users
FROM orders GROUP BY 1""",
    "ticket_seasonality_day": """
SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, count(DISTINCT user_id) AS users
FROM events GROUP BY 1""",
    "ticket_popularity": """
SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM events GROUP BY event_type""",
    "ticket_popularity_event": """
SELECT l_partkey, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM lineitem GROUP BY l_partkey""",
    "ticket_share_change": """
WITH weeks AS (
  SELECT date_trunc('week', ts)::DATE AS period, count(*) AS total FROM events GROUP BY 1),
grid AS (SELECT period, event_type FROM weeks CROSS JOIN (SELECT DISTINCT event_type FROM events)),
counts AS (
  SELECT date_trunc('week', ts)::DATE AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2),
shares AS (
  SELECT g.period, g.event_type, coalesce(c.n, 0) AS n, coalesce(p.n, 0) AS n_before,
         coalesce(c.n, 0)::DOUBLE / w.total AS share,
         coalesce(p.n, 0)::DOUBLE / b.total AS share_before
  FROM grid g JOIN weeks w ON w.period = g.period
  LEFT JOIN weeks b ON b.period = g.period - 7
  LEFT JOIN counts c ON c.period = g.period AND c.event_type = g.event_type
  LEFT JOIN counts p ON p.period = g.period - 7 AND p.event_type = g.event_type)
SELECT strftime(period, '%Y-%m-%d') AS period, event_type, n::BIGINT AS n, share, share_before,
       share - share_before AS change
FROM shares WHERE n > 0 OR n_before > 0""",
    "ticket_device_activity": f"""WITH {_DEVICES}
SELECT device, count(DISTINCT user_id) AS users, count(*) AS actions,
       count(*) / count(DISTINCT user_id) AS actions_per_user
FROM device_events GROUP BY device""",
    "ticket_price_profile": """
SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, count(value) AS n,
       sum(value::DECIMAL(12,2))::DOUBLE / count(value) AS mean_price,
       round(stddev_samp(value), 6) AS stddev_price,
       round(quantile_cont(value, 0.25), 6) AS price_q1,
       round(quantile_cont(value, 0.5), 6) AS price_median,
       round(quantile_cont(value, 0.75), 6) AS price_q3
FROM events GROUP BY event_type, date_trunc('week', ts)""",
    "ticket_device_overlap": f"""WITH {_DEVICES}, per_user AS (
  SELECT user_id, count(DISTINCT device) AS n FROM device_events GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (n > 1) AS in_several_groups,
       count(*) FILTER (n > 1) / count(*) AS share
FROM per_user""",
    "ticket_device_welch": f"""WITH {_DEVICES}, per_user AS (
  SELECT device, user_id, count(*) AS actions FROM one_device GROUP BY device, user_id),
{sql_welch("per_user", "device", "actions", "'mobile'", "'desktop'")}""",
    "ticket_device_mwu": f"""WITH {_DEVICES}, valued AS (
  SELECT value, count(*) FILTER (device = 'mobile') AS a, count(*) FILTER (device = 'desktop') AS b
  FROM one_device GROUP BY value),
ordered AS (SELECT *, sum(b) OVER (ORDER BY value) - b AS below FROM valued),
counted AS (
  SELECT sum(a)::DOUBLE AS n_a, sum(b)::DOUBLE AS n_b, sum(a * (below + b / 2e0))::DOUBLE AS u,
         sum((a + b)::DOUBLE ^ 3 - (a + b)) AS ties
  FROM ordered),
tested AS (
  SELECT *, (u - n_a * n_b / 2) / sqrt(n_a * n_b / 12
         * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z_value
  FROM counted)
SELECT n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, u, round(z_value, 6) AS z,
       abs(z_value) >= 1.959963984540054 AS significant,
       round({sql_p_value("z_value")}, 6) AS p_value
FROM tested""",
}
