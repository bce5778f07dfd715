"""Property market on the parts table."""

from __future__ import annotations

from ..operators.estate import by_distance, market_value, typical
from .tables import plain, table


def _parts(spark, d):
    return table(spark, d, "part").withColumnsRenamed(
        {"p_type": "object_type", "p_retailprice": "price", "p_size": "area", "p_brand": "brand"}
    )


def estate_value(spark, d):
    values = market_value(_parts(spark, d), ["object_type"], "price", "area")
    return plain(values, {"median_price": 6, "median_price_per_area": 6})


def estate_typical(spark, d):
    return plain(typical(_parts(spark, d), ["object_type"], ["price", "area"], ["brand"]))


def estate_by_distance(spark, d):
    parts = _parts(spark, d)
    result = by_distance(
        parts.withColumn("distance", parts.area),
        "distance",
        [1, 10, 25, 51],
        ["object_type"],
        "price",
        "area",
        ["area"],
        ["brand"],
    )
    return plain(result, {"median_price": 6, "median_price_per_area": 6})


QUERIES = {
    "estate_value": estate_value,
    "estate_typical": estate_typical,
    "estate_by_distance": estate_by_distance,
}

SQL = {
    "estate_value": """
SELECT p_type AS object_type, count(*) AS n, round(median(p_retailprice), 6) AS median_price,
       round(median(p_retailprice / p_size), 6) AS median_price_per_area
FROM part GROUP BY p_type""",
    "estate_typical": """
WITH brands AS (
  SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS rn
  FROM part GROUP BY p_type, p_brand)
SELECT p_type AS object_type, count(*) AS n, median(p_retailprice) AS median_price,
       median(p_size::DOUBLE) AS median_area, any_value(b.p_brand) AS mode_brand
FROM part JOIN brands b USING (p_type) WHERE rn = 1 GROUP BY p_type""",
    "estate_by_distance": """
WITH banded AS (
  SELECT *, CASE WHEN p_size < 1 THEN NULL WHEN p_size < 10 THEN '[1,10)'
                 WHEN p_size < 25 THEN '[10,25)' WHEN p_size < 51 THEN '[25,51)' END AS distance_band
  FROM part),
brands AS (
  SELECT p_type, distance_band, p_brand,
         row_number() OVER (PARTITION BY p_type, distance_band ORDER BY count(*) DESC, p_brand) AS rn
  FROM banded GROUP BY p_type, distance_band, p_brand)
SELECT x.distance_band, x.p_type AS object_type, count(*) AS n,
       round(median(p_retailprice), 6) AS median_price,
       round(median(p_retailprice / p_size), 6) AS median_price_per_area,
       median(p_size::DOUBLE) AS median_area, any_value(b.p_brand) AS mode_brand
FROM banded x JOIN brands b ON x.p_type = b.p_type AND x.distance_band IS NOT DISTINCT FROM b.distance_band
WHERE rn = 1 GROUP BY x.distance_band, x.p_type""",
}
