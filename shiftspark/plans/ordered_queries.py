"""Registered queries over the ordered folds: quota admission and the maintained counter."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators import ordered
from shiftspark.plans import oracle as O
from shiftspark.plans.catalog import register
from shiftspark.plans.oracle import with_fixtures as W
from shiftspark.sources.tables import Fixtures

# A day's ban would meet almost no upload of the derived table, which spans years.
ADMISSION_BAN_HOURS = 60 * 24
ADMISSION_LIMITS = K.DEFAULT_QUOTAS | {"ban_duration_hours": ADMISSION_BAN_HOURS}
_MB = 1024 * 1024

# One event of every ip a step: the service's own order of checks.
_FOLD = f"""
ev AS (
  SELECT kind, id, coalesce(ip_address, 'unknown') AS ip, created_at, coalesce(size, 0) AS size,
         row_number() OVER (PARTITION BY coalesce(ip_address, 'unknown') ORDER BY created_at, id) AS n FROM admission_events),
fold AS (
  SELECT CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS id, ip, CAST(NULL AS TIMESTAMP) AS created_at, CAST(0 AS BIGINT) AS size,
         CAST(0 AS BIGINT) AS n, CAST('' AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS models, CAST(0 AS BIGINT) AS violations,
         CAST(NULL AS TIMESTAMP) AS banned_at
  FROM (SELECT DISTINCT ip FROM ev)
  UNION ALL
  SELECT kind, id, ip, created_at, size, n, outcome,
         used + CASE WHEN outcome = 'accepted' THEN 3 * size ELSE 0 END,
         models + CASE WHEN outcome = 'accepted' AND kind = 'session' THEN 1 ELSE 0 END,
         violations + CASE WHEN outcome IN ('models', 'storage') THEN 1 ELSE 0 END,
         coalesce(banned_at, CASE WHEN outcome IN ('models', 'storage') AND violations + 1 = {K.DEFAULT_QUOTAS["ban_after_violations"]} THEN created_at END)
  FROM (
    SELECT e.kind, e.id, e.ip, e.created_at, e.size, e.n, f.used, f.models, f.violations, f.banned_at,
           CASE WHEN e.created_at < f.banned_at + INTERVAL {ADMISSION_BAN_HOURS} HOUR THEN 'banned'
                WHEN e.kind = 'upload' AND e.size > {50 * _MB} THEN 'too_large'
                WHEN e.kind = 'upload' AND f.used + 3 * e.size > {500 * _MB} THEN 'storage'
                WHEN e.kind = 'session' AND f.models >= 10 THEN 'models'
                ELSE 'accepted' END AS outcome
    FROM fold f JOIN ev e ON e.ip = f.ip AND e.n = f.n + 1)),
decided AS (SELECT * FROM fold WHERE n > 0)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@register("quota_admission", _recursive(W(_FOLD + """
SELECT kind, id, ip AS ip_address, created_at, size, outcome FROM decided""", "admission_events")))
def q_quota_admission(spark, sf):
    return ordered.quota_admission(Fixtures(spark, sf).admission_events(), ADMISSION_LIMITS)


@register("quota_admission_per_ip", _recursive(W(_FOLD + f"""
SELECT ip AS ip_address, count(CASE WHEN outcome = 'accepted' THEN 1 END) AS accepted, count(CASE WHEN outcome = 'models' THEN 1 END) AS models,
       count(CASE WHEN outcome = 'storage' THEN 1 END) AS storage, count(CASE WHEN outcome = 'too_large' THEN 1 END) AS too_large,
       count(CASE WHEN outcome = 'banned' THEN 1 END) AS banned, CAST(max(violations) AS BIGINT) AS violations,
       max(used) / {_MB}.0 AS storage_mb, max(banned_at) AS banned_at, max(banned_at) + INTERVAL {ADMISSION_BAN_HOURS} HOUR AS banned_until
FROM decided GROUP BY ip""", "admission_events")))
def q_quota_admission_per_ip(spark, sf):
    return ordered.admission_per_ip(ordered.quota_admission(Fixtures(spark, sf).admission_events(), ADMISSION_LIMITS), ADMISSION_LIMITS)


@register("models_counter", W(f"""
moved AS (
  SELECT session_id, CASE WHEN octet > 64 THEN '10.0.0.64' ELSE concat('10.', year(created_at) - 2000, '.', month(created_at), '.', octet) END AS ip,
         created_at, expires_at
  FROM (SELECT *, CAST(split_part(ip_address, '.', 4) AS INTEGER) AS octet FROM sessions)),
steps AS (
  SELECT session_id, ip, created_at, 1 AS delta FROM moved
  UNION ALL SELECT session_id, ip, expires_at, -1 FROM moved WHERE expires_at <= {O.NOW}),
summed AS (
  SELECT *, sum(delta) OVER (PARTITION BY ip ORDER BY created_at, delta DESC, session_id ROWS UNBOUNDED PRECEDING) AS s FROM steps)
SELECT session_id, ip AS ip_address, created_at, CAST(delta AS BIGINT) AS delta,
       CAST(s - least(0, min(s) OVER (PARTITION BY ip ORDER BY created_at, delta DESC, session_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS models_count
FROM summed""", "sessions"))
def q_models_counter(spark, sf):
    """Expiries before their creation make early deletions.  A third of all sessions are of one ip; the
    others are spread by month, so that counters start, and end, at zero."""
    fx = Fixtures(spark, sf)
    octet = F.split_part("ip_address", F.lit("."), F.lit(4)).cast("int")
    spread = F.concat_ws(".", F.lit("10"), (F.year("created_at") - 2000).cast("string"), F.month("created_at").cast("string"), octet.cast("string"))
    ip = F.when(octet > 64, F.lit("10.0.0.64")).otherwise(spread)
    return ordered.models_counter(fx.sessions().withColumn("ip_address", ip), fx.now())
