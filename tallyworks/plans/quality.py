"""Data quality of customers and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text_key
from ..operators.quality import (
    category_detail,
    copies,
    expect,
    heterogeneity,
    profile,
    violations,
)
from ..operators.scope import in_period
from ..sources import load, load_period, replace_period, save_by_period, save_checked, shared_folder
from .tables import money, plain, table

MIN_CHARS = 50


def dq_profile(spark, d):
    return plain(profile(table(spark, d, "customer"), exact=True))


def dq_expect(spark, d):
    return plain(expect(table(spark, d, "customer"), 1500, "c_mktsegment", 5))


def dq_violations(spark, d):
    documents = table(spark, d, "documents")
    rules = {
        "short_text": F.col("n_chars") < MIN_CHARS,
        "wrong_length": F.col("n_chars") != F.length("text"),
    }
    broken = violations(documents, rules)
    return plain(broken.unionByName(copies(documents, text_key("text"), "exact_copy")))


def _funding(spark, d):
    balance = money("c_acctbal")
    return table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("category"), F.when(balance >= 0, balance).alias("funding")
    )


def dq_heterogeneity(spark, d):
    return plain(
        heterogeneity(_funding(spark, d), "category", "funding"),
        {"cv": 6, "p10": 6, "p50": 6, "p90": 6},
    )


def dq_category_detail(spark, d):
    return plain(category_detail(_funding(spark, d), "category", "funding"), {"median": 6})


def dq_gate(spark, d):
    """Documents per broken rules, as the gate wrote them: one pass judges and splits."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    documents = table(spark, d, "documents")
    rules = {"short_text": F.col("n_chars") < MIN_CHARS, "no_language": F.col("lang").isNull()} | {
        f"from_{s}": F.col("source") == s for s in ("src1", "src2")
    }
    told = save_checked(documents, f"{folder}/kept", rules, f"{folder}/quarantine", 1.0)
    kept = load(spark, f"{folder}/kept", documents.schema).withColumn("broken_rules", F.lit("none"))
    parts = kept
    if told["quarantined"]:
        held = load(spark, f"{folder}/quarantine", documents.schema.add("broken_rules", "string"))
        parts = kept.unionByName(held)
    return plain(parts.groupBy("broken_rules").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")))


def dq_replaced(spark, d):
    """Monthly saved orders of which two months were replaced by their urgent ones."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    orders = in_period(table(spark, d, "orders"), "o_orderdate", "1996-01-01", "1996-12-31")
    save_by_period(orders, path, "o_orderdate")
    months = ("1996-03-01", "1996-04-30")
    urgent = in_period(orders, "o_orderdate", *months).filter(F.col("o_orderpriority") == "1-URGENT")
    replace_period(urgent, path, "o_orderdate", *months)
    found = load_period(spark, path, orders.schema, "o_orderdate", "1996-02-01", "1996-05-31")
    month = F.trunc("o_orderdate", "month").alias("month")
    return plain(found.groupBy(month).agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("value")))


QUERIES = {
    "dq_gate": dq_gate,
    "dq_replaced": dq_replaced,
    "dq_profile": dq_profile,
    "dq_expect": dq_expect,
    "dq_violations": dq_violations,
    "dq_heterogeneity": dq_heterogeneity,
    "dq_category_detail": dq_category_detail,
}

_FUNDING = """
startup AS (
  SELECT c_mktsegment AS category,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal::DECIMAL(12,2) END AS funding
  FROM customer
)
"""


def _profile(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS nulls,"
        f" count(DISTINCT {c}) AS distinct_values, min({c})::VARCHAR AS min_value,"
        f" max({c})::VARCHAR AS max_value FROM customer"
        for c in columns
    )


SQL = {
    "dq_gate": f"""
SELECT coalesce(nullif(concat_ws('+', CASE WHEN n_chars < {MIN_CHARS} THEN 'short_text' END,
         CASE WHEN lang IS NULL THEN 'no_language' END, CASE WHEN source = 'src1' THEN 'from_src1' END,
         CASE WHEN source = 'src2' THEN 'from_src2' END), ''), 'none') AS broken_rules,
       count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM documents GROUP BY 1""",
    "dq_replaced": """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n,
       sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS value
FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-06-01'
  AND (month(o_orderdate) IN (2, 5) OR o_orderpriority = '1-URGENT')
GROUP BY 1""",
    "dq_profile": _profile(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "dq_expect": """
SELECT count(*) AS rows, count(DISTINCT c_mktsegment) AS domain_size, count(*) = 1500 AS rows_ok,
       count(DISTINCT c_mktsegment) = 5 AS domain_ok
FROM customer""",
    "dq_violations": f"""
SELECT 'short_text' AS rule, count(*) FILTER (n_chars < {MIN_CHARS}) AS violations,
       count(*) FILTER (n_chars < {MIN_CHARS}) / count(*) AS share FROM documents
UNION ALL SELECT 'wrong_length', count(*) FILTER (n_chars <> length(text)),
       count(*) FILTER (n_chars <> length(text)) / count(*) FROM documents
UNION ALL SELECT 'exact_copy', count(*) - count(DISTINCT text),
       (count(*) - count(DISTINCT text)) / count(*) FROM documents""",
    "dq_heterogeneity": f"""WITH {_FUNDING}
SELECT category, count(*) AS n, sum(funding)::DOUBLE / count(funding) AS mean,
       round(stddev_samp(funding::DOUBLE) / avg(funding::DOUBLE), 6) AS cv,
       round(quantile_cont(funding::DOUBLE, 0.1), 6) AS p10,
       round(quantile_cont(funding::DOUBLE, 0.5), 6) AS p50,
       round(quantile_cont(funding::DOUBLE, 0.9), 6) AS p90,
       count(*) / sum(count(*)) OVER () AS share
FROM startup GROUP BY category""",
    "dq_category_detail": f"""WITH {_FUNDING}
SELECT category, count(*) AS n, count(funding) / count(*) AS filled_share,
       sum(funding)::DOUBLE AS total, round(median(funding::DOUBLE), 6) AS median
FROM startup GROUP BY category""",
}
