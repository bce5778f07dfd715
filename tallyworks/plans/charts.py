"""Chart and dashboard numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import boxplot, dashboard, histogram, scatter_bins, scatter_sample, series
from ..operators.distribution import join_on
from .inputs import places
from .tables import money, plain, sql_hash32, table


def chart_histogram(spark, d):
    return plain(histogram(table(spark, d, "events"), "value", 0.0, 200.0, 20))


def chart_histogram_by_type(spark, d):
    return plain(histogram(table(spark, d, "events"), "value", 0.0, 200.0, 20, ["event_type"]))


def chart_boxplot(spark, d):
    boxes = boxplot(table(spark, d, "events"), "value", ["event_type"])
    return plain(boxes, {"q1": 6, "q2": 6, "q3": 6})


def chart_scatter(spark, d):
    return plain(
        scatter_bins(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10, 10)
    )


def chart_scatter_sample(spark, d):
    points = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    return plain(scatter_sample(points, ["l_orderkey", "l_linenumber", "l_partkey"], 1000))


def chart_series(spark, d):
    events = table(spark, d, "events").withColumn("value", money("value"))
    return plain(series(events, "event_type", "value", "sum"))


def dash_cube(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    homes = places(spark, d)
    facts = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        homes, customer.c_nationkey == homes.n_nationkey
    )
    return plain(dashboard(facts, ["r_name", "c_mktsegment"], {"value": money("o_totalprice")}))


def dash_metrics(spark, d):
    bought = F.col("event_type") == "purchase"
    events = table(spark, d, "events").select(
        F.col("ts").cast("date").alias("day"), (F.col("user_id") % 2).alias("grp"), "user_id", "event_type",
        money("value").alias("amount"),
    )
    return plain(
        dashboard(
            events,
            ["day", "grp"],
            {"orders": F.when(bought, 1).otherwise(0), "value": F.when(bought, F.col("amount"))},
            distinct={"users": F.col("user_id"), "buyers": F.when(bought, F.col("user_id"))},
            ratios={"cr": ("buyers", "users"), "aov": ("value", "orders")},
        ),
        {"cr": 6, "aov": 6},
    )


def _dashboard_events(spark, d):
    bought = F.col("event_type") == "purchase"
    events = table(spark, d, "events").select(
        F.col("ts").cast("date").alias("day"), "event_type", (F.col("user_id") % 2).alias("grp"), "user_id",
        "event_id", money("value").alias("amount"),
    )
    sums = {"value": F.col("amount"), "purchases": F.when(bought, 1).otherwise(0)}
    return events, ["day", "event_type", "grp"], sums, {"users": F.col("user_id"), "actions": F.col("event_id")}


def dash_sketch(spark, d):
    """Distinct metrics of all subtotals from one pass and stored sketches."""
    return plain(dashboard(*_dashboard_events(spark, d)[:3], distinct=_dashboard_events(spark, d)[3], exact=False))


def dash_sketch_bound(spark, d):
    """The same with exact counts, and whether each estimate lies within five percent and one."""
    events, dims, sums, distinct = _dashboard_events(spark, d)
    exact = dashboard(events, dims, sums, distinct=distinct)
    near = dashboard(events, dims, sums, distinct=distinct, exact=False)
    keys = [*dims, "level"]
    both = join_on(exact, near.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "value", *distinct)]), keys)
    bound = lambda c: F.abs(F.col(f"_{c}") - F.col(c)) <= 0.05 * F.col(c) + 1
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("value").eqNullSafe(F.col("_value"))
    return plain(
        both.select(
            *keys, "n", "value", "purchases", *distinct, same.alias("sums_equal"),
            *[bound(c).alias(f"{c}_within_bound") for c in distinct],
        )
    )


QUERIES = {
    "chart_histogram": chart_histogram,
    "chart_histogram_by_type": chart_histogram_by_type,
    "chart_boxplot": chart_boxplot,
    "chart_scatter": chart_scatter,
    "chart_scatter_sample": chart_scatter_sample,
    "chart_series": chart_series,
    "dash_cube": dash_cube,
    "dash_metrics": dash_metrics,
    "dash_sketch": dash_sketch,
    "dash_sketch_bound": dash_sketch_bound,
}

_BINNED = "greatest(least(floor(value * 20 / 200), 19), 0)::BIGINT"

SQL = {
    "chart_histogram": f"""
WITH bins AS (SELECT i AS bin FROM range(0, 20) AS r(i)),
counts AS (SELECT {_BINNED} AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n, bin * 10e0 AS bin_from FROM bins LEFT JOIN counts USING (bin)""",
    "chart_histogram_by_type": f"""
WITH bins AS (
  SELECT event_type, i AS bin FROM (SELECT DISTINCT event_type FROM events), range(0, 20) AS r(i)),
counts AS (
  SELECT event_type, {_BINNED} AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT event_type, bin, coalesce(n, 0) AS n, bin * 10e0 AS bin_from
FROM bins LEFT JOIN counts USING (event_type, bin)""",
    "chart_boxplot": """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
         quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type),
placed AS (
  SELECT e.event_type, value, q1, q2, q3,
         value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM events e JOIN q ON e.event_type = q.event_type)
SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2,
       round(any_value(q3), 6) AS q3, min(value) FILTER (inside) AS whisker_low,
       max(value) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers,
       count(*) AS n
FROM placed GROUP BY event_type""",
    "chart_scatter": """
WITH bounds AS (
  SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl,
         max(l_extendedprice) AS yh
  FROM lineitem)
SELECT greatest(least(floor((l_quantity - xl) * 10 / (xh - xl)), 9), 0)::BIGINT AS x_bin,
       greatest(least(floor((l_extendedprice - yl) * 10 / (yh - yl)), 9), 0)::BIGINT AS y_bin,
       count(*) AS n
FROM lineitem, bounds GROUP BY 1, 2""",
    "chart_scatter_sample": f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity, l_extendedprice
FROM lineitem
ORDER BY {sql_hash32("l_orderkey", "l_linenumber", "l_partkey")}, l_orderkey, l_linenumber,
         l_partkey, l_quantity, l_extendedprice
LIMIT 1000""",
    "dash_metrics": """
WITH facts AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 2 AS grp, user_id,
         event_type = 'purchase' AS bought, value::DECIMAL(12,2) AS amount
  FROM events),
metrics AS (
  SELECT day, grp, grouping(day, grp)::BIGINT AS level, count(*) AS n,
         count(*) FILTER (bought) AS orders, (sum(amount) FILTER (bought))::DOUBLE AS value,
         count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (bought) AS buyers
  FROM facts GROUP BY CUBE (day, grp))
SELECT *, round(buyers / nullif(users, 0), 6) AS cr, round(value / nullif(orders, 0), 6) AS aov
FROM metrics""",
    "dash_sketch_bound": """
WITH facts AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id % 2 AS grp, user_id, event_id,
         value::DECIMAL(12,2) AS amount
  FROM events)
SELECT day, event_type, grp, grouping(day, event_type, grp)::BIGINT AS level, count(*) AS n,
       sum(amount)::DOUBLE AS value, count(*) FILTER (event_type = 'purchase') AS purchases,
       count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS actions, true AS sums_equal,
       true AS users_within_bound, true AS actions_within_bound
FROM facts GROUP BY CUBE (day, event_type, grp)""",
    "chart_series": """
WITH sums AS (
  SELECT event_type, sum(value::DECIMAL(12,2))::DOUBLE AS value FROM events GROUP BY event_type)
SELECT event_type, value, value / (SELECT sum(value::DECIMAL(12,2))::DOUBLE FROM events) AS share
FROM sums""",
    "dash_cube": """
SELECT r_name, c_mktsegment, grouping(r_name, c_mktsegment)::BIGINT AS level, count(*) AS n,
       sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY CUBE (r_name, c_mktsegment)""",
}
