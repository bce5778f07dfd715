"""Catering market on customers and their orders."""

from __future__ import annotations

from ..operators.catering import (
    check_and_rating,
    rank_niches,
    rank_relation,
    rating_by_check,
    relation,
    structure,
)
from ..sources import materialise
from .inputs import establishments, with_checks
from .tables import plain, sql_student_tail


def _written(spark, d):
    # Read by several branches, so the orders are joined once and not for each.
    return materialise(with_checks(spark, d))


def catering_structure(spark, d):
    return plain(structure(establishments(spark, d), ["niche", "district"]))


def catering_check(spark, d):
    return plain(
        check_and_rating(_written(spark, d), ["niche", "district"], "avg_check", "rating"),
        {"median_check": 6},
    )


def catering_relation(spark, d):
    return plain(
        relation(with_checks(spark, d), "avg_check", "rating", ["niche"]),
        {"corr": 6, "slope": 9, "r2": 6},
    )


def catering_rating_by_check(spark, d):
    return plain(
        rating_by_check(with_checks(spark, d), "avg_check", "rating", 0.0, 500_000.0, 20)
    )


def catering_niches(spark, d):
    return plain(
        rank_niches(_written(spark, d), "niche", "avg_check", "rating"), {"median_check": 6}
    )


def catering_rank_relation(spark, d):
    """Whether dearer places are rated higher, by ranks."""
    found = rank_relation(with_checks(spark, d), "avg_check", "rating", ["niche"])
    return plain(found, {"rho": 6, "t": 6, "p_value": 6})


QUERIES = {
    "catering_structure": catering_structure,
    "catering_check": catering_check,
    "catering_relation": catering_relation,
    "catering_rating_by_check": catering_rating_by_check,
    "catering_niches": catering_niches,
    "catering_rank_relation": catering_rank_relation,
}

_PLACES = """
checks AS (
  SELECT o_custkey, sum(o_totalprice::DECIMAL(12,2))::DOUBLE / count(*) AS avg_check
  FROM orders GROUP BY o_custkey),
establishment AS (
  SELECT c_mktsegment AS niche, n_name AS district, avg_check,
         c_acctbal::DECIMAL(12,2) AS rating
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN checks ON c_custkey = o_custkey
)
"""

SQL = {
    "catering_rank_relation": f"""WITH {_PLACES}, complete AS (
  SELECT niche, avg_check, rating FROM establishment WHERE avg_check IS NOT NULL AND rating IS NOT NULL),
ranked AS (
  SELECT niche,
         rank() OVER (PARTITION BY niche ORDER BY avg_check)
           + (count(*) OVER (PARTITION BY niche, avg_check) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY niche ORDER BY rating)
           + (count(*) OVER (PARTITION BY niche, rating) - 1) / 2e0 AS ry
  FROM complete),
related AS (SELECT niche, count(*) AS n, corr(rx, ry) AS rho FROM ranked GROUP BY niche),
tested AS (SELECT *, rho * sqrt(n - 2) / sqrt(1 - rho * rho) AS t_value, n - 2 AS freedom FROM related)
SELECT niche, n, round(rho, 6) AS rho, round(t_value, 6) AS t, round(p, 6) AS p_value, p <= 0.05 AS significant
FROM (SELECT *, {sql_student_tail("t_value", "freedom")} AS p FROM tested)""",
    "catering_structure": f"""WITH {_PLACES}
SELECT niche, district, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM establishment GROUP BY niche, district""",
    "catering_check": f"""WITH {_PLACES}
SELECT niche, district, count(*) AS n, sum(rating)::DOUBLE / count(rating) AS mean_rating,
       round(median(avg_check), 6) AS median_check
FROM establishment GROUP BY niche, district""",
    "catering_relation": f"""WITH {_PLACES}
SELECT niche, count(*) AS n, round(corr(rating::DOUBLE, avg_check), 6) AS corr,
       round(regr_slope(rating::DOUBLE, avg_check), 9) AS slope,
       round(regr_r2(rating::DOUBLE, avg_check), 6) AS r2
FROM establishment WHERE avg_check IS NOT NULL AND rating IS NOT NULL GROUP BY niche""",
    "catering_rating_by_check": f"""WITH {_PLACES}
SELECT greatest(least(floor((avg_check - 0) * 20 / 500000), 19), 0)::BIGINT AS check_band,
       count(rating) AS n, sum(rating)::DOUBLE / count(rating) AS mean_rating
FROM establishment WHERE avg_check IS NOT NULL GROUP BY 1""",
    "catering_niches": f"""WITH {_PLACES}, market AS (
  SELECT sum(rating)::DOUBLE / count(rating) AS market_rating FROM establishment),
niches AS (
  SELECT niche, count(*) AS n, sum(rating)::DOUBLE / count(rating) AS mean_rating,
         median(avg_check) AS median_check
  FROM establishment GROUP BY niche),
marked AS (SELECT *, mean_rating >= market_rating AS eligible FROM niches, market)
SELECT niche, n, mean_rating, round(median_check, 6) AS median_check, market_rating, eligible,
       CASE WHEN eligible THEN rank() OVER (PARTITION BY eligible ORDER BY median_check DESC) END
         AS place
FROM marked""",
}
