"""Product metrics of a delivery service on events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import (
    active_users,
    aov,
    conversion,
    daily_sketches,
    dau,
    repeat_purchase_rate,
    restaurant_ltv,
    retention,
)
from ..operators.activity import activity, retention_all, rolling_users
from ..operators.scope import in_period
from ..operators.summary import top_k
from .inputs import dated_orders, deliveries
from .tables import plain, table


DAYS = ("2024-01-01", "2024-01-31")
YEARS = ("1995-01-01", "1998-12-31")


def _events(spark, d):
    return in_period(table(spark, d, "events"), "ts", "2024-01-10", "2024-01-20")


def food_dau(spark, d):
    return plain(dau(_events(spark, d), "user_id", "ts"))


def food_dau_sketch(spark, d):
    return plain(dau(_events(spark, d), "user_id", "ts", exact=False))


def food_dau_bound(spark, d):
    """Days, and whether the estimate lies within five percent and one user of the count."""
    exact = dau(_events(spark, d), "user_id", "ts")
    estimate = dau(_events(spark, d), "user_id", "ts", exact=False).withColumnRenamed("dau", "estimate")
    near = F.abs(F.col("estimate") - F.col("dau")) <= 0.05 * F.col("dau") + 1
    return plain(exact.join(estimate, "day").select("day", "dau", near.alias("within_bound")))


def food_wau_sketch(spark, d):
    return plain(active_users(daily_sketches(_events(spark, d), "user_id", "ts"), "week"))


def food_cr(spark, d):
    return plain(conversion(_events(spark, d), "user_id", "ts", F.col("event_type") == "purchase"))


def food_aov(spark, d):
    return plain(aov(deliveries(spark, d), "order_id", "value", "ts"))


def _ltv(spark, d):
    return restaurant_ltv(deliveries(spark, d), "restaurant_id", "margin", "customer_id")


def food_ltv(spark, d):
    return plain(_ltv(spark, d))


def food_top3_ltv(spark, d):
    return plain(top_k(_ltv(spark, d), "ltv", 3, ["restaurant_id"]))


def food_repeat_rate(spark, d):
    orders = dated_orders(spark, d, "1997-05-01", "1997-06-30")
    return plain(repeat_purchase_rate(orders, "o_custkey", "o_orderkey"))


def food_retention(spark, d):
    return plain(retention(table(spark, d, "orders"), "o_custkey", "o_orderdate"))


def food_retention_day(spark, d):
    return plain(retention(table(spark, d, "events"), "user_id", "ts", "day"))


def food_retention_30(spark, d):
    """Retention after 1 to 30 days from one table of activity bitmaps."""
    seen = activity(table(spark, d, "events"), "user_id", "ts", *DAYS)
    return plain(retention_all(seen, *DAYS, 30))


def food_retention_months(spark, d):
    """Retention after 1 to 24 months of customers of the years 1995 to 1998."""
    seen = activity(table(spark, d, "orders"), "o_custkey", "o_orderdate", *YEARS, "month")
    return plain(retention_all(seen, *YEARS, 24, "month"))


def food_rolling(spark, d):
    """Users active on each day, in the 7 and in the 28 days up to it."""
    seen = activity(table(spark, d, "events"), "user_id", "ts", *DAYS)
    return plain(rolling_users(seen, *DAYS, [1, 7, 28]))


QUERIES = {
    "food_dau": food_dau,
    "food_dau_sketch": food_dau_sketch,
    "food_dau_bound": food_dau_bound,
    "food_wau_sketch": food_wau_sketch,
    "food_cr": food_cr,
    "food_aov": food_aov,
    "food_ltv": food_ltv,
    "food_top3_ltv": food_top3_ltv,
    "food_repeat_rate": food_repeat_rate,
    "food_retention": food_retention,
    "food_retention_day": food_retention_day,
    "food_retention_30": food_retention_30,
    "food_retention_months": food_retention_months,
    "food_rolling": food_rolling,
}

_EVENTS = """
seen AS (
  SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'
)
"""

_LTV = """
delivery AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ts,
         l_suppkey AS restaurant_id,
         l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) AS value,
         l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2) AS margin
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-07-01'),
ltv AS (
  SELECT restaurant_id, sum(margin)::DOUBLE AS ltv, count(DISTINCT customer_id) AS customers,
         sum(margin)::DOUBLE / count(DISTINCT customer_id) AS ltv_per_customer
  FROM delivery GROUP BY restaurant_id)
"""


def _retention(source: str, user: str, period: str, age: str) -> str:
    return f"""
WITH active AS (SELECT DISTINCT {user} AS u, {period} AS period FROM {source}),
aged AS (SELECT u, period, min(period) OVER (PARTITION BY u) AS cohort FROM active),
counts AS (SELECT cohort, {age} AS age, count(*) AS users FROM aged GROUP BY 1, 2),
sizes AS (SELECT cohort, users AS cohort_size FROM counts WHERE age = 0)
SELECT strftime(cohort, '%Y-%m-%d') AS cohort, age::BIGINT AS age, users, cohort_size,
       users / cohort_size AS retention
FROM counts JOIN sizes USING (cohort)"""


def _retention_grid(source: str, user: str, index: str, cohort: str, periods: int, ages: int) -> str:
    return f"""
WITH active AS (SELECT DISTINCT {user} AS u, {index} AS i_at FROM {source}),
aged AS (SELECT u, i_at, min(i_at) OVER (PARTITION BY u) AS start FROM active),
sizes AS (SELECT start, count(*) AS cohort_size FROM aged WHERE i_at = start GROUP BY start),
counts AS (SELECT start, i_at - start AS age, count(*) AS users FROM aged GROUP BY 1, 2)
SELECT {cohort} AS cohort, r.age, coalesce(users, 0) AS users, cohort_size,
       coalesce(users, 0) / cohort_size AS retention
FROM sizes s JOIN range(0, {ages + 1}) AS r(age) ON s.start + r.age < {periods}
LEFT JOIN counts c ON c.start = s.start AND c.age = r.age"""


SQL = {
    "food_retention_30": _retention_grid(
        "events WHERE ts < TIMESTAMP '2024-02-01'", "user_id", "ts::DATE - DATE '2024-01-01'",
        "strftime(DATE '2024-01-01' + s.start::INT, '%Y-%m-%d')", 31, 30,
    ),
    "food_retention_months": _retention_grid(
        "orders WHERE o_orderdate < TIMESTAMP '1999-01-01'", "o_custkey",
        "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1",
        "strftime(DATE '1995-01-01' + to_months(s.start::INT), '%Y-%m-%d')", 48, 24,
    ),
    "food_rolling": """
WITH days AS (SELECT DATE '2024-01-01' + k::INT AS day FROM range(0, 31) AS r(k)),
seen AS (SELECT DISTINCT user_id, ts::DATE AS i_at FROM events),
counted AS (
  SELECT day, count(DISTINCT user_id) FILTER (i_at = day) AS users_1,
         count(DISTINCT user_id) FILTER (i_at > day - 7) AS users_7, count(DISTINCT user_id) AS users_28
  FROM days LEFT JOIN seen ON i_at <= day AND i_at > day - 28 GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS period, users_1, users_7, users_28 FROM counted""",
    "food_dau": f"""WITH {_EVENTS}
SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS dau FROM seen GROUP BY 1""",
    "food_dau_bound": f"""WITH {_EVENTS}
SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS dau, true AS within_bound
FROM seen GROUP BY 1""",
    "food_cr": f"""WITH {_EVENTS}
SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users,
       count(DISTINCT user_id) FILTER (event_type = 'purchase') AS converted,
       count(DISTINCT user_id) FILTER (event_type = 'purchase') / count(DISTINCT user_id) AS cr
FROM seen GROUP BY 1""",
    "food_aov": f"""WITH {_LTV}
SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(DISTINCT order_id) AS orders,
       sum(value)::DOUBLE AS value, sum(value)::DOUBLE / count(DISTINCT order_id) AS aov
FROM delivery GROUP BY 1""",
    "food_ltv": f"WITH {_LTV} SELECT * FROM ltv",
    "food_top3_ltv": f"WITH {_LTV} SELECT * FROM ltv ORDER BY ltv DESC, restaurant_id LIMIT 3",
    "food_repeat_rate": """
WITH buyers AS (
  SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-07-01'
  GROUP BY o_custkey)
SELECT count(*) AS buyers, count(*) FILTER (n >= 2) AS repeat_buyers,
       count(*) FILTER (n >= 2) / count(*) AS repeat_rate
FROM buyers""",
    "food_retention": _retention(
        "orders",
        "o_custkey",
        "date_trunc('month', o_orderdate)::DATE",
        "(year(period) - year(cohort)) * 12 + month(period) - month(cohort)",
    ),
    "food_retention_day": _retention("events", "user_id", "ts::DATE", "period - cohort"),
}
