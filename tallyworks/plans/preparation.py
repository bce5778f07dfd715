"""Preparation steps and the period filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tier
from ..operators.prepare import (
    dedupe,
    derive,
    failed_casts,
    fill_missing,
    iqr_fence,
    normalise,
    quantile_fence,
)
from ..operators.scope import enrich, in_period, in_place
from .tables import plain, table

# Nine of the 25 nations serve as districts.
DISTRICTS = [f"NATION_{i}" for i in range(9)]


def prep_dedupe(spark, d):
    lineitem = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    rest = [c for c in lineitem.columns if c not in (*keys, "l_shipdate")]
    return plain(dedupe(lineitem, keys, [F.desc("l_shipdate"), *[F.asc(c) for c in rest]]))


def prep_fill_median(spark, d):
    unknown = F.col("c_custkey") % 10 == 0
    gaps = table(spark, d, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(~unknown, F.col("c_acctbal")).alias("c_acctbal"),
    )
    return plain(fill_missing(gaps, "c_acctbal", "median", ["c_mktsegment"]), {"c_acctbal": 6})


def _names(spark, d):
    # Numbers of customers as text, one in ten of them unreadable.
    customer = table(spark, d, "customer")
    return customer.select(
        "c_custkey",
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t ")).alias("name"),
        F.regexp_extract("c_name", r"(\d+)$", 1).alias("digits"),
    ).withColumn("digits", F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("digits")))


def prep_normalise(spark, d):
    return plain(normalise(_names(spark, d), ["name"], {"digits": "bigint"}))


def prep_failed_casts(spark, d):
    return plain(failed_casts(_names(spark, d), {"digits": "bigint", "name": "double"}))


def _values(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value")


def prep_iqr_flag(spark, d):
    flagged = iqr_fence(_values(spark, d), "value", ["event_type"])
    return plain(flagged, {"lower": 6, "upper": 6})


def prep_iqr_drop(spark, d):
    return plain(iqr_fence(_values(spark, d), "value", ["event_type"], drop=True))


def prep_quantile_flag(spark, d):
    flagged = quantile_fence(_values(spark, d), "value", ["event_type"], 0.05, 0.95)
    return plain(flagged, {"lower": 6, "upper": 6})


def prep_derive(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    derived = derive(
        orders,
        {
            "month": F.month("o_orderdate"),
            "weekday": F.weekday("o_orderdate") + 1,
            "price_tier": tier(
                F.col("o_totalprice"), [100_000, 300_000], ["low", "middle", "high"]
            ),
        },
    )
    return plain(derived.drop("o_orderdate"))


def period_filter(spark, d):
    return plain(in_period(table(spark, d, "orders"), "o_orderdate", "1997-05-01", "1997-06-30"))


def place_filter(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    placed = enrich(table(spark, d, "customer"), nations, ["c_nationkey"])
    return plain(in_place(placed, "n_name", DISTRICTS).select("c_custkey", "n_name"))


QUERIES = {
    "prep_dedupe": prep_dedupe,
    "prep_fill_median": prep_fill_median,
    "prep_normalise": prep_normalise,
    "prep_failed_casts": prep_failed_casts,
    "prep_iqr_flag": prep_iqr_flag,
    "prep_iqr_drop": prep_iqr_drop,
    "prep_quantile_flag": prep_quantile_flag,
    "prep_derive": prep_derive,
    "period_filter": period_filter,
    "place_filter": place_filter,
}

_NAMES = """
names AS (
  SELECT c_custkey, '  ' || upper(c_name) || chr(9) || ' ' AS name,
         CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE regexp_extract(c_name, '(\\d+)$', 1) END AS digits
  FROM customer
)
"""

SQL = {
    "prep_dedupe": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                 l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)
WHERE rn = 1""",
    "prep_fill_median": """
WITH gaps AS (
  SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal
  FROM customer),
medians AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM gaps GROUP BY c_mktsegment)
SELECT c_custkey, c_mktsegment, round(coalesce(c_acctbal, m), 6) AS c_acctbal
FROM gaps JOIN medians USING (c_mktsegment)""",
    "prep_normalise": f"""WITH {_NAMES}
SELECT c_custkey, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name,
       try_cast(digits AS BIGINT) AS digits,
       digits IS NOT NULL AND try_cast(digits AS BIGINT) IS NULL AS digits_failed
FROM names""",
    "prep_failed_casts": f"""WITH {_NAMES}
SELECT count(*) FILTER (digits IS NOT NULL AND try_cast(digits AS BIGINT) IS NULL) AS digits,
       count(*) FILTER (name IS NOT NULL AND try_cast(name AS DOUBLE) IS NULL) AS name
FROM names""",
    "prep_iqr_flag": """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type)
SELECT event_id, event_type, value, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier
FROM events JOIN q USING (event_type)""",
    "prep_iqr_drop": """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type)
SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
WHERE value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "prep_quantile_flag": """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95
  FROM events GROUP BY event_type)
SELECT event_id, event_type, value, round(q05, 6) AS lower, round(q95, 6) AS upper,
       value < q05 OR value > q95 AS is_outlier
FROM events JOIN q USING (event_type)""",
    "prep_derive": """
SELECT o_orderkey, o_totalprice, month(o_orderdate)::BIGINT AS month,
       isodow(o_orderdate)::BIGINT AS weekday,
       CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'middle'
            ELSE 'high' END AS price_tier
FROM orders""",
    "place_filter": """
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey < 9""",
    "period_filter": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-07-01'""",
}
