"""Registered queries: name -> (Spark plan over a scale-factor folder, oracle SQL).

Every query reads the driver's tables (through the derived service tables of
``sources.tables``) in full; none runs on fixed literal input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators import audit, features, forecast, model, quality, quotas
from shiftspark.plans import oracle as O
from shiftspark.plans.oracle import with_fixtures as W
from shiftspark.sources import csv_ingest
from shiftspark.sources.tables import Fixtures
from shiftspark.session import scratch_dir

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return deco


# Limits used by the rate/ban queries on the derived log: the declared limits
# (60/min, 5/h, 1000/day) never bind on this data, so the registered queries
# use a policy that does: 5 requests per ip and day, then 2 predictions per
# ip and hour; a ban after 3 violations for 24 hours.
FIXTURE_LIMITS = (
    quotas.RateLimit("request", "1 day", 5),
    quotas.RateLimit("predict", "1 hour", 2, (K.EVENT_PREDICTION_MADE,)),
)
FIXTURE_BAN_AFTER = 3
FIXTURE_BAN_HOURS = 24
# The log spans 30 days, so the declared policy (30 days, beyond 10,000 rows)
# never drops a row of it; this one does.
FIXTURE_LOG_DAYS = 15
FIXTURE_LOG_ROWS = 500


# ---------------------------------------------------------------------------
# Schedule, features, encoding
# ---------------------------------------------------------------------------
@register("schedule_features", W(f"""
SELECT id, date, start_time_by_minutes, end_time_by_minutes, {O.FEATURES_SQL}
FROM schedule""", "schedule"))
def q_schedule_features(spark, sf):
    return features.add_features(Fixtures(spark, sf).schedule())


@register("id_encoding", W("""
SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS id_encoded
FROM (SELECT DISTINCT id FROM schedule)""", "schedule"))
def q_id_encoding(spark, sf):
    return features.id_index(Fixtures(spark, sf).schedule())


@register("schedule_last_record", W("""
SELECT id, date,
       arg_max(start_time_by_minutes, row_seq) AS start_time_by_minutes,
       arg_max(end_time_by_minutes, row_seq) AS end_time_by_minutes
FROM schedule_events GROUP BY id, date""", "schedule_events"))
def q_schedule_last_record(spark, sf):
    return features.last_record(Fixtures(spark, sf).schedule_events())


@register("minutes_to_time", W(f"""
SELECT row_seq, id, date,
       {O.minutes_to_time_sql('start_time_by_minutes')} AS start_time,
       {O.minutes_to_time_sql('end_time_by_minutes')} AS end_time
FROM schedule_events""", "schedule_events"))
def q_minutes_to_time(spark, sf):
    from shiftspark.functions.timeparts import minutes_to_time
    ev = Fixtures(spark, sf).schedule_events()
    return ev.select("row_seq", K.ID, K.DATE,
                     minutes_to_time(K.START).alias("start_time"),
                     minutes_to_time(K.END).alias("end_time"))


@register("training_summary", W(f"""
SELECT TRUE AS is_trained, {O.NOW} AS trained_at, count(*) AS data_row_count,
       count(DISTINCT id) AS entity_count,
       'id_encoded,day_of_week,week_of_month,week_of_year,month,day_of_year' AS features,
       'RandomForestRegressor' AS model_type, 100 AS n_estimators, 10 AS max_depth,
       42 AS random_state,
       CAST(greatest(8, ceil(count(*) / 500000.0)) AS INTEGER) AS fit_partitions,
       CAST(greatest(366, count(DISTINCT id)) AS INTEGER) AS max_bins
FROM schedule""", "schedule"))
def q_training_summary(spark, sf):
    fx = Fixtures(spark, sf)
    return model.training_summary(fx.schedule(), fx.now())


def raw_upload(events: DataFrame) -> DataFrame:
    """Upload text rows derived from events: ISO dates, HH:MM clock text.
    End times wrap past midnight as a clock would, so overnight rows appear."""
    mins = F.hour("ts") * 60 + F.minute("ts")
    end = (mins + 30 + F.col("event_id") % 400) % 1440

    def clock(m):
        return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))

    return events.select(F.col("user_id").cast("string").alias("ID"),
                         F.date_format("ts", "yyyy-MM-dd").alias("Date"),
                         clock(mins).alias("Start Time"), clock(end).alias("End Time"))


@register("schedule_clean", """
SELECT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date,
       CAST(m AS DOUBLE) AS start_time_by_minutes,
       CAST((m + 30 + event_id % 400) % 1440 AS DOUBLE) AS end_time_by_minutes
FROM (SELECT *, hour(ts)*60 + minute(ts) AS m FROM events)
WHERE m > 0 AND (m + 30 + event_id % 400) % 1440 > m""")
def q_schedule_clean(spark, sf):
    fx = Fixtures(spark, sf)
    path = scratch_dir(spark, "upload-csv")
    raw_upload(fx.table("events")).write.option("header", True).option("sep", ";").csv(path)
    return csv_ingest.load_schedule_csv(spark, path).drop("row_seq")


def rough_upload(events: DataFrame) -> DataFrame:
    """Upload lines as people send them, derived from events: commas, d/m/Y dates,
    quoted ids, missing ids, impossible dates, unreadable and out-of-range clock
    text, rows without their last field.  One text column, named by the header."""
    n = F.col("event_id")
    mins = F.hour("ts") * 60 + F.minute("ts")

    def clock(m):
        return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))

    user = F.col("user_id").cast("string")
    ident = (F.when(n % 11 == 0, "").when(n % 11 == 1, "NA")
             .when(n % 11 == 2, F.concat(F.lit('"'), user, F.lit(', x"')))
             .when(n % 11 == 3, F.concat(F.lit('"say ""'), user, F.lit('"""'))).otherwise(user))
    date = F.when(n % 13 == 0, "31/02/2024").otherwise(F.date_format("ts", "dd/MM/yyyy"))
    start = F.when(n % 17 == 0, "00:99").when(n % 17 == 1, "8:3").otherwise(clock(mins))
    short = F.concat_ws(",", ident, date, start)
    return events.select(F.when(n % 19 == 0, short).otherwise(F.concat_ws(",", short, clock(mins + 30 + n % 400)))
                         .alias("ID,Date,Start Time,End Time"))


@register("schedule_clean_rough", """
SELECT CASE WHEN n % 11 = 2 THEN u || ', x' WHEN n % 11 = 3 THEN 'say "' || u || '"' ELSE u END AS id,
       CAST(ts AS DATE) AS date,
       CAST(CASE WHEN n % 17 = 0 THEN 99 ELSE m END AS DOUBLE) AS start_time_by_minutes,
       CAST(m + 30 + n % 400 AS DOUBLE) AS end_time_by_minutes
FROM (SELECT *, event_id AS n, CAST(user_id AS VARCHAR) AS u, hour(ts)*60 + minute(ts) AS m FROM events)
WHERE n % 11 > 1 AND n % 13 <> 0 AND n % 17 <> 1 AND n % 19 <> 0
  AND CASE WHEN n % 17 = 0 THEN 99 ELSE m END > 0
  AND m + 30 + n % 400 > CASE WHEN n % 17 = 0 THEN 99 ELSE m END""")
def q_schedule_clean_rough(spark, sf):
    fx = Fixtures(spark, sf)
    path = scratch_dir(spark, "upload-csv")
    # One text column, written as it is: neither separator nor quote occurs in it.
    (rough_upload(fx.table("events")).write.option("header", True).option("sep", "\u0001")
     .option("quote", "\u0002").csv(path))
    return csv_ingest.load_schedule_csv(spark, path).drop("row_seq")


@register("stored_schedule", W("""
SELECT row_seq, id, date, start_time_by_minutes, end_time_by_minutes,
       'w' || CAST(weekofyear(date) AS VARCHAR) AS dataset_id
FROM schedule_events""", "schedule_events"))
def q_stored_schedule(spark, sf):
    """S5 + S6: one data set per ISO week written with dynamic partition
    overwrite, then every data set read back."""
    from shiftspark.sources import store
    return store.read_datasets(spark, _write_weekly_store(spark, sf))


def _write_weekly_store(spark: SparkSession, sf: str) -> str:
    """The derived schedule stored as one data set per ISO week; returns the path."""
    from shiftspark.functions.timeparts import iso_week
    from shiftspark.sources import store
    ev = Fixtures(spark, sf).schedule_events()
    path = scratch_dir(spark, "schedule-store")
    store.save_datasets(ev.withColumn("_ds", F.concat(F.lit("w"), iso_week(K.DATE).cast("string"))),
                        path, "_ds")
    return path


@register("dataset_inventory", None)
def q_dataset_inventory(spark, sf):
    """S10 + S11: files and bytes per stored data set, from a ``binaryFile``
    listing that never reads content (file sizes have no SQL oracle)."""
    from shiftspark.sources import store
    return store.dataset_sizes(spark, _write_weekly_store(spark, sf))


@register("stored_datasets", W("""
SELECT 'w' || CAST(weekofyear(date) AS VARCHAR) AS dataset_id, count(*) AS rows
FROM schedule_events GROUP BY 1""", "schedule_events"))
def q_stored_datasets(spark, sf):
    """The data sets of the store and their rows."""
    from shiftspark.sources import store
    return store.dataset_rows(spark, _write_weekly_store(spark, sf))


# ---------------------------------------------------------------------------
# Forecast
# ---------------------------------------------------------------------------
_CALENDAR_SQL = """
cal AS (
  SELECT r.id, r.target_date, r.window_size,
         CAST(unnest(generate_series(r.target_date - CAST(floor(r.window_size / 2) AS INTEGER),
                                     r.target_date + CAST(floor(r.window_size / 2) AS INTEGER),
                                     INTERVAL 1 DAY)) AS DATE) AS date
  FROM prediction_requests r WHERE r.window_size >= 0)"""


@register("forecast_calendar", W(_CALENDAR_SQL + "\nSELECT * FROM cal", "prediction_requests"))
def q_forecast_calendar(spark, sf):
    return forecast.calendar(Fixtures(spark, sf).prediction_requests())


@register("forecast_history", W(_CALENDAR_SQL + f""",
known AS (SELECT DISTINCT id FROM schedule)
SELECT c.id, c.target_date, c.window_size, c.date AS day,
       strftime(c.date, '%d/%m/%Y') AS date,
       {O.WEEKDAY_SQL.format(d='c.date')} AS weekday,
       CASE WHEN s.id IS NOT NULL THEN {O.minutes_to_time_sql('s.start_time_by_minutes')} END AS start_time,
       CASE WHEN s.id IS NOT NULL THEN {O.minutes_to_time_sql('s.end_time_by_minutes')} END AS end_time,
       s.id IS NOT NULL AS historical
FROM cal c JOIN known k ON c.id = k.id
LEFT JOIN schedule s ON s.id = c.id AND s.date = c.date""", "prediction_requests", "schedule"))
def q_forecast_history(spark, sf):
    fx = Fixtures(spark, sf)
    sched = stored_schedule_of(fx)
    return forecast.forecast_history(fx.prediction_requests(), sched, features.id_index(sched))


def stored_schedule_of(fx: Fixtures) -> DataFrame:
    """The derived schedule written once to the shared folder, as the service
    stores an upload; its several readers (codes, fit, history) scan it
    instead of re-aggregating the events."""
    from shiftspark.session import write_and_read
    return write_and_read(fx.schedule(), "schedule")


@register("unknown_entities", W("""
known AS (SELECT DISTINCT id FROM schedule)
SELECT r.id, r.target_date, r.window_size,
       CASE WHEN r.target_date IS NULL THEN 'invalid_date' ELSE 'unknown_id' END AS reason
FROM prediction_requests r
WHERE r.target_date IS NULL OR r.id NOT IN (SELECT id FROM known)""",
                                  "prediction_requests", "schedule"))
def q_unknown_entities(spark, sf):
    fx = Fixtures(spark, sf)
    return forecast.request_rejects(fx.prediction_requests(), features.id_index(fx.schedule()))


@register("requested_histories", W("""
SELECT * FROM schedule_events WHERE id IN (SELECT id FROM prediction_requests)""",
                                     "schedule_events", "prediction_requests"))
def q_requested_histories(spark, sf):
    """P5 for every requested entity: its stored rows (duplicates and order kept)."""
    from shiftspark.sources.store import entities_history
    fx = Fixtures(spark, sf)
    return entities_history(fx.schedule_events(), fx.prediction_requests())


@register("forecast_model", None)
def q_forecast_model(spark, sf):
    return forecast_with_model(spark, sf)


_SERVED_SQL = """
SELECT '{kind}' AS kind, c.id, c.target_date, c.window_size, c.date AS day,
       strftime(c.date, '%d/%m/%Y') AS date, {weekday} AS weekday,
       CASE WHEN s.id IS NOT NULL THEN {start} END AS start_time,
       CASE WHEN s.id IS NOT NULL THEN {end} END AS end_time,
       s.id IS NOT NULL AS historical, TRUE AS usable
FROM {calendar} c JOIN known k ON c.id = k.id
LEFT JOIN schedule s ON s.id = c.id AND s.date = c.date"""


def _served_sql() -> str:
    parts = {"weekday": O.WEEKDAY_SQL.format(d="c.date"), "start": O.minutes_to_time_sql("s.start_time_by_minutes"),
             "end": O.minutes_to_time_sql("s.end_time_by_minutes")}
    single = """,
single AS (SELECT id, target_date, 1 AS window_size, target_date AS date FROM prediction_requests WHERE target_date IS NOT NULL),
known AS (SELECT DISTINCT id FROM schedule)"""
    return (_CALENDAR_SQL + single + _SERVED_SQL.format(kind="window", calendar="cal", **parts)
            + "\nUNION ALL" + _SERVED_SQL.format(kind="single_day", calendar="single", **parts))


@register("forecast_served", W(_served_sql(), "prediction_requests", "schedule"))
def q_forecast_served(spark, sf):
    """Train, save, load, then serve every request's window (M6, M10) and its single
    day (M7).  Recorded days with their times; a predicted day's pair is reduced to
    whether it is usable: two clock times in order, or NA for both."""
    served = _served(spark, sf)
    window, single = forecast.forecast(*served), forecast.forecast_single_day(*served)
    return _usable(window.withColumn("kind", F.lit("window")).unionByName(single.withColumn("kind", F.lit("single_day"))))


def _served(spark: SparkSession, sf: str) -> tuple:
    """(requests, schedule, model, codes): the model goes through its store."""
    fx = Fixtures(spark, sf)
    sched = stored_schedule_of(fx)
    index = features.id_index(sched)
    fitted = model.fit_models(features.training_frame(sched, index))
    path = scratch_dir(spark, "model")
    model.save_models(fitted, index, model.training_summary(sched, fx.now()), path)
    loaded, codes, _ = model.load_models(spark, path)
    return fx.prediction_requests(), sched, loaded, codes


def _usable(rows: DataFrame) -> DataFrame:
    clock = r"^[0-9]{2,}:[0-9]{2}$"
    start, end, hist = F.col("start_time"), F.col("end_time"), F.col("historical")
    pair = start.rlike(clock) & end.rlike(clock) & (F.lpad(end, 8, "0") >= F.lpad(start, 8, "0"))
    na = (start == K.NA_VALUE) & (end == K.NA_VALUE)
    return rows.withColumns({"usable": F.coalesce(hist | pair | na, F.lit(False)),
                             "start_time": F.when(hist, start), "end_time": F.when(hist, end)})


@register("session_information", W(f"""
SELECT s.session_id, s.ip_address, s.created_at, s.last_accessed, s.expires_at,
       s.expires_at <= {O.NOW} AS is_expired, l.id IS NOT NULL AS is_trained,
       coalesce(CAST(json_extract(l.event_data, '$.data_row_count') AS BIGINT), 0) AS data_row_count,
       coalesce(CAST(json_extract(l.event_data, '$.entity_count') AS BIGINT), 0) AS entity_count
FROM sessions s LEFT JOIN (SELECT * FROM security_logs WHERE event_type = 'model_trained' AND event_data LIKE '{{%') l
  ON l.session_id = s.session_id""", "sessions", "security_logs"))
def q_session_information(spark, sf):
    """Every session with its training's counts, 0 where it has none."""
    from shiftspark.plans import jobs
    fx = Fixtures(spark, sf)
    t = quotas.training_counts(fx.security_logs()).where(~F.col("is_text"))
    summaries = t.select(F.col("session_id").alias("dataset_id"), F.lit(True).alias("is_trained"),
                         F.col("data_points").alias("data_row_count"), F.col("entities").alias("entity_count"))
    return jobs.session_info(fx.sessions(), summaries, fx.now())


def forecast_with_model(spark: SparkSession, sf: str, params: model.ForestParams = model.ForestParams()):
    """Train both forests on the derived schedule, then serve every request."""
    fx = Fixtures(spark, sf)
    sched = stored_schedule_of(fx)
    index = features.id_index(sched)
    fitted = model.fit_models(features.training_frame(sched, index), params)
    return forecast.forecast(fx.prediction_requests(), sched, fitted, index)


# ---------------------------------------------------------------------------
# Audit views
# ---------------------------------------------------------------------------
@register("active_sessions", W(f"""
SELECT session_id, ip_address, created_at, last_accessed, expires_at, metadata,
       {O.units(O.NOW, 'expires_at', O.DAY_US)} AS days_until_expiry,
       {O.units('last_accessed', O.NOW, O.HOUR_US)} AS hours_since_last_access
FROM sessions WHERE expires_at > {O.NOW}""", "sessions"))
def q_active_sessions(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.active_sessions(fx.sessions(), fx.now())


@register("expired_sessions", W(f"""
SELECT session_id, ip_address, created_at, last_accessed, expires_at,
       {O.units('expires_at', O.NOW, O.DAY_US)} AS days_expired
FROM sessions WHERE expires_at <= {O.NOW}""", "sessions"))
def q_expired_sessions(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.expired_sessions(fx.sessions(), fx.now())


@register("ip_statistics", W(f"""
SELECT s.ip_address, count(s.session_id) AS total_sessions,
       count(CASE WHEN s.expires_at > {O.NOW} THEN 1 END) AS active_sessions,
       count(CASE WHEN s.expires_at <= {O.NOW} THEN 1 END) AS expired_sessions,
       min(s.created_at) AS first_session_date, max(s.last_accessed) AS last_activity_date,
       coalesce(any_value(q.storage_used_mb), 0.0) AS storage_used_mb,
       coalesce(any_value(q.is_banned), FALSE) AS is_banned
FROM sessions s LEFT JOIN ip_quotas q ON s.ip_address = q.ip_address
GROUP BY s.ip_address""", "sessions", "ip_quotas"))
def q_ip_statistics(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.ip_statistics(fx.sessions(), fx.ip_quotas(), fx.now())


@register("recent_security_events", W(f"""
SELECT id, session_id, ip_address, event_type, event_data, severity, created_at,
       {O.units('created_at', O.NOW, O.MINUTE_US)} AS minutes_ago
FROM security_logs WHERE created_at > {O.NOW} - INTERVAL 24 HOUR""", "security_logs"))
def q_recent_security_events(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.recent_security_events(fx.security_logs(), fx.now())


@register("suspicious_ips", W(f"""
SELECT ip_address, violations_count, is_banned, banned_until, requests_count, train_count,
       predictions_count, last_reset,
       CASE WHEN is_banned AND banned_until > {O.NOW} THEN 'BANNED'
            WHEN violations_count >= 5 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM ip_quotas WHERE violations_count > 0 OR is_banned""", "ip_quotas"))
def q_suspicious_ips(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.suspicious_ips(fx.ip_quotas(), fx.now())


@register("system_statistics", W(f"""
SELECT (SELECT count(*) FROM sessions) AS total_sessions,
       (SELECT count(*) FROM sessions WHERE expires_at > {O.NOW}) AS active_sessions,
       (SELECT count(*) FROM sessions WHERE expires_at <= {O.NOW}) AS expired_sessions,
       (SELECT count(DISTINCT ip_address) FROM sessions) AS unique_ips,
       (SELECT count(*) FROM ip_quotas WHERE is_banned) AS banned_ips,
       (SELECT coalesce(sum(storage_used_mb), 0.0) FROM ip_quotas) AS total_storage_mb,
       (SELECT count(*) FROM security_logs WHERE created_at > {O.NOW} - INTERVAL 24 HOUR)
         AS security_events_24h""", "sessions", "ip_quotas", "security_logs"))
def q_system_statistics(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.system_statistics(fx.sessions(), fx.ip_quotas(), fx.security_logs(), fx.now())


@register("live_sessions_per_ip", W("""
SELECT ip_address, count(*) AS models_count FROM sessions GROUP BY ip_address""", "sessions"))
def q_live_sessions_per_ip(spark, sf):
    return audit.live_sessions_per_ip(Fixtures(spark, sf).sessions())


@register("last_access_per_session", W("""
SELECT s.session_id, s.ip_address, coalesce(l.last_accessed, s.last_accessed) AS last_accessed,
       coalesce(l.accesses, 0) AS accesses
FROM sessions s LEFT JOIN (SELECT session_id, max(created_at) AS last_accessed, count(*) AS accesses
                      FROM security_logs WHERE session_id IS NOT NULL GROUP BY session_id) l
  ON s.session_id = l.session_id""", "sessions", "security_logs"))
def q_last_access_per_session(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.last_access_per_session(fx.security_logs(), fx.sessions())


@register("suspicious_ip_sessions", W(f"""
SELECT session_id, ip_address, created_at, last_accessed, expires_at, metadata,
       {O.units(O.NOW, 'expires_at', O.DAY_US)} AS days_until_expiry,
       {O.units('last_accessed', O.NOW, O.HOUR_US)} AS hours_since_last_access
FROM sessions
WHERE expires_at > {O.NOW}
  AND ip_address IN (SELECT ip_address FROM ip_quotas WHERE violations_count > 0 OR is_banned)""",
                                        "sessions", "ip_quotas"))
def q_suspicious_ip_sessions(spark, sf):
    """P18 + P11 + P7: active sessions of every suspicious ip (a semi join)."""
    fx = Fixtures(spark, sf)
    return audit.sessions_of_ip(fx.sessions(), audit.suspicious_ips(fx.ip_quotas(), fx.now()),
                                fx.now())


@register("sessions_with_warnings", W("""
SELECT * FROM sessions
WHERE session_id IN (SELECT session_id FROM security_logs WHERE severity = 'WARNING')""",
                                        "sessions", "security_logs"))
def q_sessions_with_warnings(spark, sf):
    """Sessions looked up by the ids of WARNING events (a batch lookup)."""
    fx = Fixtures(spark, sf)
    logs = fx.security_logs()
    return audit.lookup_sessions(fx.sessions(), logs.where(F.col("severity") == K.SEVERITY_WARNING))


@register("orphan_datasets", W("""
SELECT session_id, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes,
       sum(length) / 1048576.0 AS size_mb
FROM file_inventory WHERE session_id NOT IN (SELECT session_id FROM sessions)
GROUP BY session_id""", "file_inventory", "sessions"))
def q_orphan_datasets(spark, sf):
    fx = Fixtures(spark, sf)
    return audit.orphan_datasets(fx.file_inventory(), fx.sessions())


@register("session_cascade_delete", W(f"""
SELECT l.* FROM security_logs l
WHERE l.session_id IS NULL OR l.session_id NOT IN
  (SELECT session_id FROM sessions WHERE expires_at <= {O.NOW})""", "security_logs", "sessions"))
def q_session_cascade_delete(spark, sf):
    fx = Fixtures(spark, sf)
    _, logs = audit.cleanup_expired(fx.sessions(), fx.security_logs(), fx.now(), cascade=True)
    return logs


_LIFECYCLE_T1 = "TIMESTAMP '2024-01-01 00:00:00'"


@register("session_lifecycle_events", W(f"""
before AS (SELECT * FROM sessions WHERE created_at <= {_LIFECYCLE_T1} AND expires_at > {_LIFECYCLE_T1}),
after AS (SELECT * FROM sessions WHERE created_at <= {O.NOW} AND expires_at > {O.NOW})
SELECT session_id, ip_address, 'session_created' AS event_type,
       '{{"session_id":"' || session_id || '","expires_at":"' ||
         strftime(expires_at, '%Y-%m-%d %H:%M:%S') || '"}}' AS event_data,
       'INFO' AS severity, {O.NOW} AS created_at
FROM after WHERE session_id NOT IN (SELECT session_id FROM before)
UNION ALL
SELECT session_id, ip_address, 'session_deleted' AS event_type,
       '{{"session_id":"' || session_id || '","created_at":"' ||
         strftime(created_at, '%Y-%m-%d %H:%M:%S') || '","last_accessed":"' ||
         strftime(last_accessed, '%Y-%m-%d %H:%M:%S') || '"}}' AS event_data,
       'INFO' AS severity, {O.NOW} AS created_at
FROM before WHERE session_id NOT IN (SELECT session_id FROM after)""", "sessions"))
def q_session_lifecycle_events(spark, sf):
    fx = Fixtures(spark, sf)
    t1 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    # Both snapshots are the session table at two times: one scan, no join.
    return audit.lifecycle_events_between(fx.sessions(), t1, fx.now())


# ---------------------------------------------------------------------------
# Quality
# ---------------------------------------------------------------------------
@register("session_rejects", W("""
SELECT session_id, ip_address, created_at, expires_at, metadata,
       CASE WHEN NOT regexp_full_match(session_id, '[0-9a-fA-F]{64}') THEN 'bad_token'
            WHEN expires_at <= created_at THEN 'expiry_not_in_future'
            WHEN metadata IS NOT NULL AND NOT json_valid(metadata) THEN 'invalid_metadata_json'
       END AS reason
FROM sessions
WHERE NOT regexp_full_match(session_id, '[0-9a-fA-F]{64}') OR expires_at <= created_at
   OR (metadata IS NOT NULL AND NOT json_valid(metadata))""", "sessions"))
def q_session_rejects(spark, sf):
    return quality.session_rejects(Fixtures(spark, sf).sessions())


_RETENTION_SQL = W(f"""
SELECT * FROM security_logs
WHERE (SELECT count(*) FROM security_logs) <= {FIXTURE_LOG_ROWS}
   OR created_at >= {O.NOW} - INTERVAL {FIXTURE_LOG_DAYS} DAY""", "security_logs")


@register("log_retention", _RETENTION_SQL)
def q_log_retention(spark, sf):
    fx = Fixtures(spark, sf)
    return quality.log_retention(fx.security_logs(), fx.now(), FIXTURE_LOG_DAYS, FIXTURE_LOG_ROWS)


# The clean-up runs a quarter of a day after midnight, so that it parts its border's day.
FIXTURE_CLEAN_HOURS = 6


@register("log_retention_by_day", _RETENTION_SQL.replace(O.NOW, f"{O.NOW} + INTERVAL {FIXTURE_CLEAN_HOURS} HOUR"))
def q_log_retention_by_day(spark, sf):
    """S7 + P16: the log appended in two batches, stored by day, then cleaned up in place."""
    from shiftspark.sources import audit_store
    fx = Fixtures(spark, sf)
    logs, path = fx.security_logs(), scratch_dir(spark, "audit-log")
    for warned in (F.col("severity") == "WARNING", F.col("severity") != "WARNING"):
        audit_store.append_by_day(logs.where(warned), path)
    audit_store.clean_by_day(spark, path, fx.now() + F.expr(f"INTERVAL {FIXTURE_CLEAN_HOURS} HOURS"), FIXTURE_LOG_DAYS, FIXTURE_LOG_ROWS)
    return audit_store.read_by_day(spark, path).drop(audit_store.DAY)


@register("dataset_profile", W("""
SELECT count(*) AS data_points, count(DISTINCT id) AS entities,
       count(*) <= 100000 AS within_max_data_points,
       count(DISTINCT id) <= 10000 AS within_max_entities
FROM schedule_events""", "schedule_events"))
def q_dataset_profile(spark, sf):
    return quality.dataset_profile(Fixtures(spark, sf).schedule_events())


# ---------------------------------------------------------------------------
# Quotas, rates, bans
# ---------------------------------------------------------------------------
@register("ip_changes", W("""
SELECT l.id AS access_id, l.session_id, l.ip_address, s.ip_address AS old_ip,
       'ip_changed' AS event_type,
       '{"old_ip": "' || s.ip_address || '", "new_ip": "' || l.ip_address || '"}' AS event_data,
       'WARNING' AS severity, l.created_at
FROM security_logs l JOIN sessions s ON l.session_id = s.session_id
WHERE l.created_at >= s.created_at AND l.created_at <= s.expires_at
  AND l.ip_address <> s.ip_address""", "security_logs", "sessions"))
def q_ip_changes(spark, sf):
    fx = Fixtures(spark, sf)
    return quotas.ip_changes(fx.security_logs(), fx.sessions())


@register("usage_by_window", W("""
trained AS (
  SELECT id, session_id, created_at,
         regexp_full_match(event_data, 'entities=[0-9]+, data_points=[0-9]+') AS is_text,
         TRY_CAST(CASE WHEN regexp_full_match(event_data, 'entities=[0-9]+, data_points=[0-9]+')
                  THEN regexp_extract(event_data, 'entities=([0-9]+)', 1)
                  ELSE json_extract_string(event_data, '$.entity_count') END AS BIGINT) AS entities,
         TRY_CAST(CASE WHEN regexp_full_match(event_data, 'entities=[0-9]+, data_points=[0-9]+')
                  THEN regexp_extract(event_data, 'data_points=([0-9]+)', 1)
                  ELSE json_extract_string(event_data, '$.data_row_count') END AS BIGINT) AS data_points
  FROM security_logs WHERE event_type = 'model_trained'),
dup AS (
  SELECT j.id FROM trained j JOIN trained t
    ON j.session_id = t.session_id AND j.entities = t.entities AND j.data_points = t.data_points
   AND t.is_text AND NOT j.is_text
   AND t.created_at >= j.created_at AND t.created_at <= j.created_at + INTERVAL 60 SECOND),
logs AS (SELECT * FROM security_logs WHERE id NOT IN (SELECT id FROM dup))
SELECT ip_address, date_trunc('hour', created_at) AS window_start,
       date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end,
       count(*) AS requests,
       count(CASE WHEN event_type = 'model_trained' THEN 1 END) AS trainings,
       count(CASE WHEN event_type = 'prediction_made' THEN 1 END) AS predictions
FROM logs GROUP BY ip_address, date_trunc('hour', created_at)""", "security_logs"))
def q_usage_by_window(spark, sf):
    return quotas.usage_by_window(Fixtures(spark, sf).security_logs(), "1 hour")


# Oracle form of FIXTURE_LIMITS: position by row_number over the whole group.
_RATE_SQL = """
{name}_r1 AS (
  SELECT *, date_trunc('day', created_at) AS w1,
         row_number() OVER (PARTITION BY ip_address, date_trunc('day', created_at)
                            ORDER BY created_at, id) AS p1
  FROM {src}),
{name}_r2 AS (
  SELECT {name}_r1.*, date_trunc('hour', created_at) AS w2,
         CASE WHEN p1 <= 5 AND event_type = 'prediction_made' THEN
           row_number() OVER (PARTITION BY ip_address, date_trunc('hour', created_at),
                                           (p1 <= 5 AND event_type = 'prediction_made')
                              ORDER BY created_at, id) END AS p2
  FROM {name}_r1),
{name} AS (
  SELECT *, CASE WHEN p1 > 5 THEN 'request' WHEN p2 > 2 THEN 'predict' END AS rejected_by,
         CASE WHEN p1 > 5 THEN w1 WHEN p2 > 2 THEN w2 END AS window_start
  FROM {name}_r2)"""


@register("rate_rejects", W(_RATE_SQL.format(src="security_logs", name="checked") + """
SELECT id, ip_address, event_type, created_at, rejected_by AS action, window_start
FROM checked WHERE rejected_by IS NOT NULL""", "security_logs"))
def q_rate_rejects(spark, sf):
    return quotas.rate_rejects(Fixtures(spark, sf).security_logs(), FIXTURE_LIMITS)


@register("bans", W(_RATE_SQL.format(src="security_logs", name="pass1") + """,
ban AS (
  SELECT ip_address, created_at AS banned_at, id AS ban_id,
         created_at + INTERVAL 24 HOUR AS banned_until
  FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY created_at, id) AS k
        FROM pass1 WHERE rejected_by IS NOT NULL) WHERE k = 3),
marked AS (
  SELECT l.*, b.banned_at, b.ban_id, b.banned_until,
         coalesce(b.banned_at IS NOT NULL
                  AND (l.created_at > b.banned_at OR (l.created_at = b.banned_at AND l.id > b.ban_id))
                  AND l.created_at < b.banned_until, FALSE) AS refused
  FROM security_logs l LEFT JOIN ban b ON l.ip_address = b.ip_address),
kept AS (SELECT id, session_id, ip_address, event_type, event_data, severity, created_at
         FROM marked WHERE NOT refused),
""" + _RATE_SQL.format(src="kept", name="pass2").strip() + """,
per_ip AS (
  SELECT ip_address, count(CASE WHEN rejected_by IS NULL THEN 1 END) AS accepted,
         count(rejected_by) AS violations
  FROM pass2 GROUP BY ip_address),
ref AS (SELECT ip_address, count(*) AS refused_while_banned FROM marked WHERE refused GROUP BY ip_address)
SELECT p.ip_address, p.accepted, p.violations, coalesce(r.refused_while_banned, 0) AS refused_while_banned,
       b.banned_at IS NOT NULL AS is_banned, b.banned_at, b.banned_until
FROM per_ip p LEFT JOIN ref r ON p.ip_address = r.ip_address
LEFT JOIN ban b ON p.ip_address = b.ip_address""", "security_logs"))
def q_bans(spark, sf):
    return quotas.bans(Fixtures(spark, sf).security_logs(), FIXTURE_LIMITS,
                       FIXTURE_BAN_AFTER, FIXTURE_BAN_HOURS)


@register("unban_expired", W(f"""
SELECT ip_address, requests_count, train_count, predictions_count,
       CASE WHEN is_banned AND banned_until <= {O.NOW} THEN 0 ELSE violations_count END AS violations_count,
       CASE WHEN is_banned AND banned_until <= {O.NOW} THEN FALSE ELSE is_banned END AS is_banned,
       CASE WHEN is_banned AND banned_until <= {O.NOW} THEN NULL ELSE banned_until END AS banned_until,
       storage_used_mb, last_reset, created_at
FROM ip_quotas""", "ip_quotas"))
def q_unban_expired(spark, sf):
    fx = Fixtures(spark, sf)
    return quotas.unban_ended(fx.ip_quotas(), fx.now())


@register("default_quotas", W(f"""
SELECT * FROM ip_quotas
UNION ALL
SELECT ip_address, 0 AS requests_count, 0 AS train_count, 0 AS predictions_count,
       0 AS violations_count, FALSE AS is_banned, CAST(NULL AS TIMESTAMP) AS banned_until,
       0.0 AS storage_used_mb, {O.NOW} AS last_reset, {O.NOW} AS created_at
FROM (SELECT DISTINCT ip_address FROM sessions)
WHERE ip_address NOT IN (SELECT ip_address FROM ip_quotas)""", "ip_quotas", "sessions"))
def q_default_quotas(spark, sf):
    fx = Fixtures(spark, sf)
    return quotas.default_quotas(fx.ip_quotas(), fx.sessions(), fx.now())


@register("storage_per_ip", W("""
SELECT s.ip_address, count(*) AS datasets, coalesce(sum(f.bytes), 0) / 1048576.0 AS storage_mb
FROM sessions s LEFT JOIN (SELECT session_id, sum(length) AS bytes FROM file_inventory
                           GROUP BY session_id) f ON s.session_id = f.session_id
GROUP BY s.ip_address""", "sessions", "file_inventory"))
def q_storage_per_ip(spark, sf):
    fx = Fixtures(spark, sf)
    return quotas.storage_per_ip(fx.sessions(), fx.file_inventory())


@register("quota_compliance", W(f"""
live AS (SELECT ip_address, count(*) AS models_count FROM sessions GROUP BY ip_address),
stored AS (
  SELECT s.ip_address, coalesce(sum(f.bytes), 0) / 1048576.0 AS storage_mb
  FROM sessions s LEFT JOIN (SELECT session_id, sum(length) AS bytes FROM file_inventory
                             GROUP BY session_id) f ON s.session_id = f.session_id
  GROUP BY s.ip_address),
q AS (
  SELECT q.ip_address,
         q.is_banned AND (q.banned_until IS NULL OR {O.NOW} < q.banned_until) AS currently_banned,
         coalesce(l.models_count, 0) AS models_count, coalesce(s.storage_mb, 0.0) AS storage_mb
  FROM ip_quotas q LEFT JOIN live l ON q.ip_address = l.ip_address
  LEFT JOIN stored s ON q.ip_address = s.ip_address)
SELECT ip_address, currently_banned, models_count, storage_mb,
       NOT currently_banned AND models_count < 10 AS can_create_session,
       NOT currently_banned AND storage_mb + 3 * 0.0 <= 500 AS storage_ok
FROM q""", "ip_quotas", "sessions", "file_inventory"))
def q_quota_compliance(spark, sf):
    fx = Fixtures(spark, sf)
    return quotas.quota_compliance(fx.ip_quotas(), fx.sessions(), fx.file_inventory(), fx.now())


def _register_all() -> None:
    """Queries of other modules register themselves on import."""
    import shiftspark.plans.forest_queries
    import shiftspark.plans.order_queries
    import shiftspark.plans.ordered_queries
    import shiftspark.streaming.late
    import shiftspark.streaming.live_sessions
    import shiftspark.streaming.usage  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _register_all()
    return {name: e.fn for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _register_all()
    return {name: e.sql for name, e in REGISTRY.items() if e.sql is not None}
