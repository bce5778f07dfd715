"""A/B test on the sessions of the event stream."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators.bootstrap import bootstrap_ratio, poisson_thresholds
from ..operators.experiment import (
    duration,
    group_counts,
    overlap,
    sample_size,
    sessions_per_user,
    srm,
    success_share,
    two_proportion_z,
)
from .inputs import session_table
from .tables import plain, sql_hash32, sql_p_value, table
from .tickets import sql_welch

MDE = 0.03


def ab_sample_size(spark, d):
    return plain(sample_size(session_table(spark, d), "success", MDE))


def ab_duration(spark, d):
    needed = sample_size(session_table(spark, d), "success", MDE)
    return plain(duration(needed, table(spark, d, "events"), "user_id", "ts"))


def ab_sessions(spark, d):
    exact = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ended")}
    return plain(session_table(spark, d).withColumns(exact))


def ab_group_counts(spark, d):
    return plain(
        group_counts(session_table(spark, d), "grp", "user_id", "registrations", "page_views")
    )


def ab_success_share(spark, d):
    return plain(success_share(session_table(spark, d), "grp", "success"))


def ab_two_prop_z(spark, d):
    tested = two_proportion_z(session_table(spark, d), "grp", "success", 0, 1)
    return plain(tested, {"difference": 6, "z": 6, "p_value": 6})


def ab_two_prop_z_by_user(spark, d):
    tested = two_proportion_z(
        session_table(spark, d), "grp", "success", 0, 1, cluster="user_id"
    )
    return plain(tested, {"difference": 6, "z": 6, "p_value": 6})


def ab_sessions_per_user(spark, d):
    digits = ["mean_a", "var_a", "mean_b", "var_b", "difference", "t", "df", "p_value"]
    return plain(
        sessions_per_user(session_table(spark, d), "grp", "user_id", 0, 1),
        dict.fromkeys(digits, 6),
    )


def ab_srm(spark, d):
    return plain(
        srm(session_table(spark, d), "grp", "user_id", 0, 1), {"chi2": 6, "p_value": 6}
    )


def ab_overlap(spark, d):
    events = table(spark, d, "events").withColumn("grp", F.col("event_id") % 2)
    return plain(overlap(events, "grp", "user_id"))


REPLICATES = 200


def ab_bootstrap(spark, d):
    """Difference of purchases per session with an interval that draws whole users."""
    found = bootstrap_ratio(
        session_table(spark, d), "grp", "user_id", "purchases", "actions", 0, 1, replicates=REPLICATES
    )
    return plain(found, {"difference": 9, "low": 9, "high": 9, "std_error": 9})


QUERIES = {
    "ab_sample_size": ab_sample_size,
    "ab_duration": ab_duration,
    "ab_sessions": ab_sessions,
    "ab_group_counts": ab_group_counts,
    "ab_success_share": ab_success_share,
    "ab_two_prop_z": ab_two_prop_z,
    "ab_two_prop_z_by_user": ab_two_prop_z_by_user,
    "ab_sessions_per_user": ab_sessions_per_user,
    "ab_srm": ab_srm,
    "ab_overlap": ab_overlap,
    "ab_bootstrap": ab_bootstrap,
}

_SESSIONS = """
paused AS (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS earlier FROM events),
numbered AS (
  SELECT *, sum(CASE WHEN ts - earlier < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no
  FROM paused),
session AS (
  SELECT user_id, user_id % 2 AS grp, session_no::BIGINT AS session_no,
         strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started,
         strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS actions,
         count(*) FILTER (event_type = 'purchase') AS purchases,
         count(*) FILTER (event_type = 'signup') AS registrations,
         count(*) FILTER (event_type = 'view') AS page_views,
         count(*) FILTER (event_type = 'purchase') > 0 AS success
  FROM numbered GROUP BY user_id, session_no),
per_user AS (
  SELECT grp, user_id, count(*) AS n, count(*) FILTER (success) AS s FROM session GROUP BY grp, user_id)
"""

_Z_ALPHA = NormalDist().inv_cdf(0.975)
_Z_POWER = NormalDist().inv_cdf(0.8)

_NEEDED = f"""
base AS (SELECT count(*) FILTER (success) / count(*) AS baseline FROM session),
aimed AS (SELECT baseline, baseline + {MDE}::DOUBLE AS target FROM base),
needed AS (
  SELECT baseline, target, ceil((({_Z_ALPHA}::DOUBLE
           * sqrt(2 * ((baseline + target) / 2) * (1 - (baseline + target) / 2))
         + {_Z_POWER}::DOUBLE * sqrt(baseline * (1 - baseline) + target * (1 - target)))
         / {MDE}::DOUBLE) ^ 2)::BIGINT AS n_per_group
  FROM aimed)
"""

_VERDICT = f"""
SELECT n_a, s_a AS successes_a, n_b, s_b AS successes_b, s_a / n_a AS share_a, s_b / n_b AS share_b,
       round(s_b / n_b - s_a / n_a, 6) AS difference, round(z_value, 6) AS z,
       abs(z_value) >= {_Z_ALPHA} AS significant,
       round({sql_p_value("z_value")}, 6) AS p_value
FROM tested"""

_WEIGHT = " + ".join(f"(h >= {t})::INT" for t in poisson_thresholds())

SQL = {
    "ab_bootstrap": f"""
WITH units AS (
  SELECT user_id % 2 AS g, user_id, count(*) FILTER (event_type = 'purchase') AS x, count(*) AS y
  FROM events GROUP BY user_id),
hashed AS (
  SELECT g, x, y, r, {sql_hash32("user_id", "r", seed=1)} AS h FROM units, range(0, {REPLICATES + 1}) AS t(r)),
drawn AS (SELECT g, x, y, r, CASE WHEN r = 0 THEN 1 ELSE {_WEIGHT} END AS w FROM hashed),
each AS (
  SELECT r, (sum(w * x) FILTER (g = 1))::DOUBLE / (sum(w * y) FILTER (g = 1))::DOUBLE
         - (sum(w * x) FILTER (g = 0))::DOUBLE / (sum(w * y) FILTER (g = 0))::DOUBLE AS d
  FROM drawn GROUP BY r),
ends AS (
  SELECT max(d) FILTER (r = 0) AS difference, quantile_cont(d, 0.025) FILTER (r > 0) AS low,
         quantile_cont(d, 0.975) FILTER (r > 0) AS high, stddev_samp(d) FILTER (r > 0) AS std_error,
         count(d) FILTER (r > 0) AS replicates
  FROM each)
SELECT round(difference, 9) AS difference, round(low, 9) AS low, round(high, 9) AS high,
       round(std_error, 9) AS std_error, replicates, low > 0 OR high < 0 AS significant
FROM ends""",
    "ab_sample_size": f"WITH {_SESSIONS}, {_NEEDED} SELECT * FROM needed",
    "ab_duration": f"""WITH {_SESSIONS}, {_NEEDED}, traffic AS (
  SELECT count(DISTINCT user_id) AS users, max(ts::DATE) - min(ts::DATE) + 1 AS observed_days
  FROM events)
SELECT users, observed_days::BIGINT AS observed_days, users / observed_days AS daily_new_users,
       n_per_group * 2 AS n_required,
       ceil((n_per_group * 2) / (users / observed_days))::BIGINT AS days
FROM traffic, needed""",
    "ab_sessions": f"WITH {_SESSIONS} SELECT * FROM session",
    "ab_group_counts": f"""WITH {_SESSIONS}
SELECT grp, count(DISTINCT user_id) AS users, count(*) AS sessions,
       sum(registrations)::BIGINT AS registrations, sum(page_views)::BIGINT AS page_views
FROM session GROUP BY grp""",
    "ab_success_share": f"""WITH {_SESSIONS}
SELECT grp, count(*) AS sessions, count(*) FILTER (success) AS successes,
       count(*) FILTER (success) / count(*) AS share
FROM session GROUP BY grp""",
    "ab_two_prop_z": f"""WITH {_SESSIONS}, counted AS (
  SELECT count(*) FILTER (grp = 0) AS n_a, count(*) FILTER (grp = 0 AND success) AS s_a,
         count(*) FILTER (grp = 1) AS n_b, count(*) FILTER (grp = 1 AND success) AS s_b
  FROM session),
tested AS (
  SELECT *, (s_b / n_b - s_a / n_a) / sqrt((s_a + s_b) / (n_a + n_b)
         * (1 - (s_a + s_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b)) AS z_value
  FROM counted)
{_VERDICT}""",
    "ab_two_prop_z_by_user": f"""WITH {_SESSIONS}, counted AS (
  SELECT grp, count(*) AS k, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, var_samp(s) AS vs, var_samp(n) AS vn,
         covar_samp(s, n) AS c
  FROM per_user GROUP BY grp),
spread AS (
  SELECT grp, n, s, k * (vs - 2 * (s / n) * c + (s / n) * (s / n) * vn) / (n::DOUBLE * n) AS v
  FROM counted),
tested AS (
  SELECT a.n AS n_a, a.s AS s_a, b.n AS n_b, b.s AS s_b,
         (b.s / b.n - a.s / a.n) / sqrt(a.v + b.v) AS z_value
  FROM spread a, spread b WHERE a.grp = 0 AND b.grp = 1)
{_VERDICT}""",
    "ab_sessions_per_user": f"""WITH {_SESSIONS},
{sql_welch("per_user", "grp", "n", "0", "1")}""",
    "ab_srm": f"""WITH {_SESSIONS}, counted AS (
  SELECT count(DISTINCT user_id) FILTER (grp = 0) AS users_a,
         count(DISTINCT user_id) FILTER (grp = 1) AS users_b
  FROM session),
tested AS (
  SELECT *, (users_a - (users_a + users_b) / 2e0) ^ 2 / ((users_a + users_b) / 2e0)
         + (users_b - (users_a + users_b) / 2e0) ^ 2 / ((users_a + users_b) / 2e0) AS x
  FROM counted)
SELECT users_a, users_b, round(x, 6) AS chi2, sqrt(x) >= {_Z_ALPHA} AS significant,
       round(CASE WHEN x = 0 THEN 1 ELSE {sql_p_value("sqrt(x)")} END, 6) AS p_value
FROM tested""",
    "ab_overlap": """
WITH per_user AS (
  SELECT user_id, count(DISTINCT event_id % 2) AS n FROM events GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (n > 1) AS in_several_groups,
       count(*) FILTER (n > 1) / count(*) AS share
FROM per_user""",
}
