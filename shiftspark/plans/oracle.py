"""DuckDB SQL for every registered query (the correctness oracle).

The derived tables are common table expressions over the driver's views, so
each oracle statement is self-contained.  The SQL is written independently of
the Spark code paths: where Spark uses a threshold join, the SQL uses a plain
``row_number()``; where Spark parses text, the SQL computes from the source.
"""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

FIXTURE_CTES = {
    "schedule_events": """
schedule_events AS (
  SELECT event_id AS row_seq, CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date,
         CAST(hour(ts)*60 + minute(ts) AS DOUBLE) AS start_time_by_minutes,
         CAST(hour(ts)*60 + minute(ts) + 30 + event_id % 400 AS DOUBLE) AS end_time_by_minutes
  FROM events WHERE hour(ts)*60 + minute(ts) > 0)""",
    "schedule": """
schedule AS (
  SELECT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date,
         CAST(min(hour(ts)*60 + minute(ts)) AS DOUBLE) AS start_time_by_minutes,
         CAST(max(hour(ts)*60 + minute(ts)) AS DOUBLE) AS end_time_by_minutes
  FROM events GROUP BY CAST(user_id AS VARCHAR), CAST(ts AS DATE)
  HAVING min(hour(ts)*60 + minute(ts)) > 0
     AND max(hour(ts)*60 + minute(ts)) > min(hour(ts)*60 + minute(ts)))""",
    "prediction_requests": """
prediction_requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 41 <> 5 THEN DATE '2024-01-25' END AS target_date,
         CASE WHEN c_custkey % 37 <> 1 THEN CAST(c_custkey % 33 - 1 AS INTEGER) ELSE 31 END AS window_size
  FROM customer)""",
    "sessions": """
sessions AS (
  SELECT CASE WHEN o_orderkey % 53 = 7 THEN substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 63)
              ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS session_id,
         concat('10.0.0.', CAST(o_custkey % 97 AS VARCHAR)) AS ip_address,
         o_orderdate + INTERVAL 8217 DAY AS created_at,
         o_orderdate + INTERVAL 8217 DAY + INTERVAL 9 HOUR + INTERVAL 30 MINUTE AS last_accessed,
         CASE WHEN o_orderkey % 59 = 3 THEN o_orderdate + INTERVAL 8216 DAY
              ELSE o_orderdate + INTERVAL 8582 DAY END AS expires_at,
         CASE WHEN o_orderkey % 10 = 0 THEN concat('{', chr(39), 'a', chr(39), ': 1}')
              ELSE '{"a":1}' END AS metadata
  FROM orders)""",
    "ip_quotas": """
ip_quotas AS (
  SELECT concat('10.0.0.', CAST(user_id % 89 AS VARCHAR)) AS ip_address,
         count(*) AS requests_count,
         count(CASE WHEN event_type = 'purchase' THEN 1 END) AS train_count,
         count(CASE WHEN event_type = 'view' THEN 1 END) AS predictions_count,
         count(CASE WHEN event_type = 'error' THEN 1 END) % 10 AS violations_count,
         min(user_id) % 4 = 0 AS is_banned,
         CASE WHEN min(user_id) % 8 = 0 THEN max(ts) + INTERVAL 24 HOUR END AS banned_until,
         CAST(count(*) * 0.5 AS DOUBLE) AS storage_used_mb,
         max(ts) AS last_reset, min(ts) AS created_at
  FROM events
  GROUP BY concat('10.0.0.', CAST(user_id % 89 AS VARCHAR)))""",
    "security_logs": """
log_rows AS (
  SELECT *, event_id AS row_id, ts AS logged_at,
         CASE WHEN event_type = 'purchase' THEN printf('{"entity_count":%d,"data_row_count":%d}', event_id % 50 + 1, event_id % 900 + 10)
              ELSE props END AS data FROM events
  UNION ALL
  SELECT *, -event_id - 1 AS row_id, ts + to_seconds(event_id % 120) AS logged_at,
         printf('entities=%d, data_points=%d', event_id % 50 + 1, event_id % 900 + 10) AS data
  FROM events WHERE event_type = 'purchase'),
security_logs AS (
  SELECT row_id AS id, sha256(CAST(event_id AS VARCHAR)) AS session_id,
         concat('10.0.0.', CAST(user_id % 97 AS VARCHAR)) AS ip_address,
         CASE event_type WHEN 'view' THEN 'prediction_made' WHEN 'click' THEN 'session_accessed'
              WHEN 'signup' THEN 'session_created' WHEN 'purchase' THEN 'model_trained'
              ELSE 'rate_limit_hit' END AS event_type,
         data AS event_data,
         CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS severity,
         logged_at AS created_at FROM log_rows)""",
    "admission_events": """
admission_events AS (
  SELECT 'session' AS kind, o_orderkey * 2 AS id,
         CASE WHEN o_orderkey % 3 = 0 THEN '10.0.0.7' WHEN o_custkey % 89 <> 5 THEN concat('10.0.0.', o_custkey % 97) END AS ip_address,
         o_orderdate + INTERVAL 8217 DAY AS created_at, CAST(NULL AS BIGINT) AS size FROM orders
  UNION ALL
  SELECT 'upload', doc_id * 2 + 1,
         CASE WHEN doc_id % 3 = 0 THEN '10.0.0.7' WHEN doc_id % 89 <> 5 THEN concat('10.0.0.', doc_id % 97) END,
         TIMESTAMP '2017-06-01' + to_days(CAST(doc_id * 7919 % 2400 AS INTEGER)) + to_seconds(doc_id % 86400), n_chars * 8192 FROM documents)""",
    "file_inventory": """
file_inventory AS (
  SELECT sha256(CAST((doc_id - doc_id % 3) * 30 AS VARCHAR)) AS session_id,
         concat('f', CAST(doc_id AS VARCHAR)) AS file_name, n_chars AS length FROM documents)""",
}


def with_fixtures(body: str, *names: str) -> str:
    """``WITH <fixtures>, <body>``: body may start with more CTEs (no WITH)."""
    ctes = ",".join(FIXTURE_CTES[n] for n in names)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes},\n{body}"


# Whole-units difference truncated toward zero (DuckDB's // truncates too).
def units(start: str, end: str, micros: int) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) // {micros})"


DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

# Calendar features in DuckDB terms (Monday = 0).
FEATURES_SQL = """
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  CAST(ceil((day(date) + isodow(date_trunc('month', date)) - 1) / 7.0) - 1 AS INTEGER) AS week_of_month,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year,
  CAST(month(date) AS INTEGER) AS month,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year"""


def minutes_to_time_sql(x: str) -> str:
    t = f"CAST(round_even({x}, 0) AS BIGINT)"
    return f"(CASE WHEN {x} <= 0 THEN '00:00' ELSE printf('%02d:%02d', {t} // 60, {t} % 60) END)"


WEEKDAY_SQL = "(['mon','tue','wed','thu','fri','sat','sun'])[isodow({d})]"
