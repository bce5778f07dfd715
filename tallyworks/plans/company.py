"""Company rating."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.rating import growth, leaders, rating, return_on_sales
from ..operators.scope import enrich, in_region_by_capacity
from ..sources.tables import materialise
from .inputs import (
    CAPACITY_SHARE,
    RATING_YEAR,
    REGION,
    THRESHOLD,
    company_lines,
    company_profile,
    company_year,
    largest,
    registrations,
    sales,
)
from .tables import plain

YEAR = (f"{RATING_YEAR}-01-01", f"{RATING_YEAR}-12-31")
TWO_YEARS = (f"{RATING_YEAR - 1}-01-01", f"{RATING_YEAR}-12-31")


def rating_scope(spark, d):
    lines = company_lines(sales(spark, d, *YEAR, buyers=True))
    cells = lines.groupBy("company_id", "buyer_region").agg(F.sum("revenue").alias("revenue"))
    whole = F.sum("revenue").over(Window.partitionBy("company_id"))
    capacity = (
        cells.withColumn("_all", whole)
        .filter(F.col("revenue") >= F.col("_all") * CAPACITY_SHARE)
        .select("company_id", F.col("buyer_region").alias("region"))
    )
    companies = cells.groupBy("company_id").agg(F.sum("revenue").alias("revenue"))
    known = enrich(companies, registrations(spark, d), ["company_id"])
    return plain(in_region_by_capacity(known, REGION, capacity, ["company_id"]))


def rating_ros(spark, d):
    return plain(return_on_sales(company_year(spark, d)).select("company_id", "year", "ros"))


def rating_growth(spark, d):
    grown = company_year(spark, d)
    for measure in ("revenue", "net_profit"):
        grown = growth(grown, "company_id", "year", measure)
    return plain(
        grown.select(
            "company_id",
            "year",
            "revenue_growth",
            "revenue_from_loss",
            "net_profit_growth",
            "net_profit_from_loss",
        )
    )


def rating_leaders(spark, d):
    parts = (
        company_lines(sales(spark, d, *YEAR))
        .groupBy("company_id", "p_type")
        .agg(F.sum("revenue").alias("revenue"))
    )
    rated = parts.groupBy("company_id").agg(
        F.sum("revenue").alias("revenue"), largest("p_type", "revenue").alias("sector")
    )
    return plain(leaders(rated, "sector", "revenue"))


def rating_table(spark, d):
    years = enrich(
        company_profile(spark, d, *TWO_YEARS), registrations(spark, d), ["company_id"]
    )
    return plain(rating(years, RATING_YEAR, REGION, THRESHOLD, capacity="cap_regions"))


def rating_saved(spark, d):
    """The rating written with ``save`` to the shared folder and read with ``load``."""
    return materialise(rating_table(spark, d))


QUERIES = {
    "rating_scope": rating_scope,
    "rating_ros": rating_ros,
    "rating_growth": rating_growth,
    "rating_leaders": rating_leaders,
    "rating_table": rating_table,
    "rating_saved": rating_saved,
}

_LINES = """
line AS (
  SELECT l_suppkey AS company_id, year(o_orderdate) AS year, p_type, r_name AS buyer_region,
         l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) AS revenue,
         2 * l_quantity::DECIMAL(12,2) * p_retailprice::DECIMAL(12,2) AS cost,
         l_tax::DECIMAL(4,2) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
), company_year AS (
  SELECT company_id, year, sum(revenue) AS revenue, sum(revenue - cost) AS sales_profit,
         sum(revenue * (1 - tax) - cost) AS net_profit
  FROM line GROUP BY company_id, year
), registered AS (
  SELECT s_suppkey AS company_id, r_name AS reg_region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), capacity AS (
  SELECT company_id, year, buyer_region FROM (
    SELECT company_id, year, buyer_region, sum(revenue) AS part,
           sum(sum(revenue)) OVER (PARTITION BY company_id, year) AS whole
    FROM line GROUP BY company_id, year, buyer_region)
  WHERE part >= 0.25 * whole
), sector AS (
  SELECT company_id, year, p_type AS sector FROM (
    SELECT company_id, year, p_type, row_number() OVER (
             PARTITION BY company_id, year ORDER BY sum(revenue) DESC, p_type) AS rn
    FROM line GROUP BY company_id, year, p_type)
  WHERE rn = 1
), scoped AS (
  SELECT c.*, reg_region FROM company_year c JOIN registered USING (company_id)
  WHERE reg_region = 'EUROPE' OR EXISTS (
    SELECT 1 FROM capacity k WHERE k.company_id = c.company_id AND k.year = c.year
    AND k.buyer_region = 'EUROPE')
), history AS (
  SELECT company_id, year,
         CASE WHEN lag(year) OVER w = year - 1 THEN lag(revenue) OVER w END AS revenue_base,
         CASE WHEN lag(year) OVER w = year - 1 THEN lag(net_profit) OVER w END AS net_base
  FROM company_year WINDOW w AS (PARTITION BY company_id ORDER BY year)
), growth AS (
  SELECT c.company_id, c.year,
         CASE WHEN revenue_base > 0 THEN revenue::DOUBLE / revenue_base::DOUBLE - 1 END AS revenue_growth,
         coalesce(revenue_base <= 0, false) AS revenue_from_loss,
         CASE WHEN net_base > 0 THEN net_profit::DOUBLE / net_base::DOUBLE - 1 END AS net_profit_growth,
         coalesce(net_base <= 0, false) AS net_profit_from_loss
  FROM company_year c JOIN history h ON c.company_id = h.company_id AND c.year = h.year
), ros AS (
  SELECT company_id, year,
         CASE WHEN revenue > 0 THEN sales_profit::DOUBLE / revenue::DOUBLE END AS ros
  FROM company_year
)
"""

SQL = {
    "rating_scope": f"""WITH {_LINES}
SELECT company_id, reg_region, revenue::DOUBLE AS revenue FROM scoped WHERE year = 2000""",
    "rating_ros": f"WITH {_LINES} SELECT company_id, year::BIGINT AS year, ros FROM ros",
    "rating_growth": f"""WITH {_LINES}
SELECT company_id, year::BIGINT AS year, revenue_growth, revenue_from_loss, net_profit_growth,
       net_profit_from_loss FROM growth""",
    "rating_leaders": f"""WITH {_LINES}, placed AS (
  SELECT c.company_id, sector, revenue::DOUBLE AS revenue,
         rank() OVER (PARTITION BY sector ORDER BY revenue DESC) AS place
  FROM company_year c JOIN sector s ON c.company_id = s.company_id AND c.year = s.year
  WHERE c.year = 2000)
SELECT company_id, sector, revenue, place FROM placed WHERE place = 1""",
    "rating_table": f"""WITH {_LINES}
SELECT rank() OVER (ORDER BY revenue DESC) AS place, c.company_id, sector,
       revenue::DOUBLE AS revenue, ros, revenue_growth, revenue_from_loss, net_profit_growth,
       net_profit_from_loss
FROM scoped c JOIN sector s ON c.company_id = s.company_id AND c.year = s.year
JOIN growth g ON c.company_id = g.company_id AND c.year = g.year
JOIN ros r ON c.company_id = r.company_id AND c.year = r.year
WHERE c.year = 2000 AND revenue >= 4000000""",
}
SQL["rating_saved"] = SQL["rating_table"]
