"""Audit views and session maintenance over (sessions, quotas, logs).

V1-V6, P7-P11, A4-A12, J4, J5, J9, R5.  ``now`` is always a Column argument.
Views sort only when asked (``ordered=True``): a global sort is a range
shuffle, so it belongs at the sink, not inside a composed plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T

SESSION_COLS = ["session_id", "ip_address", "created_at", "last_accessed", "expires_at"]


def is_active(now: Column) -> Column:
    """The view's rule, expires_at strictly after now."""
    return F.col("expires_at") > now


def is_expired(now: Column) -> Column:
    """expires_at at or before now."""
    return F.col("expires_at") <= now


def currently_banned(now: Column) -> Column:
    """Flag set and either no end or an end still ahead."""
    return F.col("is_banned") & (F.col("banned_until").isNull() | (now < F.col("banned_until")))


def active_sessions(sessions: DataFrame, now: Column, ordered: bool = False) -> DataFrame:
    """V1 = P7 + F14 + F15 (+ O1)."""
    out = sessions.where(is_active(now)).select(
        *SESSION_COLS, "metadata",
        T.days_between(now, "expires_at").alias("days_until_expiry"),
        T.hours_between("last_accessed", now).alias("hours_since_last_access"))
    return out.orderBy(F.desc("last_accessed"), "session_id") if ordered else out


def expired_sessions(sessions: DataFrame, now: Column, ordered: bool = False) -> DataFrame:
    """V2 = P8 + F14 (+ O2)."""
    out = sessions.where(is_expired(now)).select(
        *SESSION_COLS, T.days_between("expires_at", now).alias("days_expired"))
    return out.orderBy(F.desc("expires_at"), "session_id") if ordered else out


def sessions_of_ip(sessions: DataFrame, ips: DataFrame, now: Column) -> DataFrame:
    """P18 + P7: active sessions of the given ips (a semi join, any number of ips)."""
    return active_sessions(sessions.join(ips.select("ip_address"), "ip_address", "left_semi"), now)


def lookup_sessions(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """Sessions by id, for a batch of ids."""
    return sessions.join(keys.select("session_id"), "session_id", "left_semi")


def first_session(sessions: DataFrame, session_id: str) -> DataFrame:
    """One-or-none lookup of a single session (a pushed-down filter + limit 1)."""
    return sessions.where(F.col("session_id") == session_id).limit(1)


def ip_statistics(sessions: DataFrame, quotas: DataFrame, now: Column) -> DataFrame:
    """V3 = A4 + A5 + J4 + A6.  Sessions are aggregated per ip before the join,
    so the join sees one row per ip on both sides."""
    per_ip = sessions.groupBy("ip_address").agg(
        F.count("session_id").alias("total_sessions"),
        F.count_if(is_active(now)).alias("active_sessions"),
        F.count_if(is_expired(now)).alias("expired_sessions"),
        F.min("created_at").alias("first_session_date"),
        F.max("last_accessed").alias("last_activity_date"))
    q = quotas.select("ip_address", "storage_used_mb", "is_banned")
    return per_ip.join(q, "ip_address", "left").select(
        "ip_address", "total_sessions", "active_sessions", "expired_sessions",
        "first_session_date", "last_activity_date",
        F.coalesce(F.col("storage_used_mb"), F.lit(0.0)).alias("storage_used_mb"),
        F.coalesce(F.col("is_banned"), F.lit(False)).alias("is_banned"))


def recent_events(logs: DataFrame, now: Column, hours: int = 24) -> Column:
    """P10: created within the last ``hours``."""
    return F.col("created_at") > T.minus_hours(now, hours)


def recent_security_events(logs: DataFrame, now: Column, ordered: bool = False) -> DataFrame:
    """V4 = P10 + F16 (+ O3)."""
    out = logs.where(recent_events(logs, now)).select(
        "id", "session_id", "ip_address", "event_type", "event_data", "severity", "created_at",
        T.minutes_between("created_at", now).alias("minutes_ago"))
    return out.orderBy(F.desc("created_at"), F.desc("id")) if ordered else out


def suspicious_ips(quotas: DataFrame, now: Column, ordered: bool = False) -> DataFrame:
    """V5 = P11 + F18 (+ O4).  Banned without an end is *not* BANNED here (Q12)."""
    out = quotas.where((F.col("violations_count") > 0) | F.col("is_banned")).select(
        "ip_address", "violations_count", "is_banned", "banned_until", "requests_count",
        "train_count", "predictions_count", "last_reset",
        T.ip_status("is_banned", "banned_until", "violations_count", now).alias("status"))
    return out.orderBy(F.desc("violations_count"), "ip_address") if ordered else out


def system_statistics(sessions: DataFrame, quotas: DataFrame, logs: DataFrame,
                      now: Column) -> DataFrame:
    """V6: one row.  The session aggregate is the anchor; quota and log figures
    are scalar subqueries (no join at all)."""
    # One pass over the quotas gives both figures.
    q = quotas.select(F.struct(F.count_if(F.col("is_banned")).alias("banned"),
                               F.coalesce(F.sum("storage_used_mb"), F.lit(0.0)).alias("mb"))).scalar()
    recent = logs.select(F.count_if(recent_events(logs, now))).scalar()
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.count_if(is_active(now)).alias("active_sessions"),
        F.count_if(is_expired(now)).alias("expired_sessions"),
        F.count_distinct("ip_address").alias("unique_ips")).select(
        "*", q.alias("_q"), recent.alias("security_events_24h")).select(
        "total_sessions", "active_sessions", "expired_sessions", "unique_ips",
        F.col("_q.banned").alias("banned_ips"), F.col("_q.mb").alias("total_storage_mb"),
        "security_events_24h")


def live_sessions_per_ip(sessions: DataFrame) -> DataFrame:
    """The models counter (+1 per insert, floor-0 -1 per delete) equals the
    number of sessions the ip still has."""
    return sessions.groupBy("ip_address").agg(F.count("*").alias("models_count"))


def last_access_per_session(logs: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Latest logged access per session (partial max, then shuffle).  With
    ``sessions``, every session has a row; without a logged access its own
    ``last_accessed`` stands."""
    last = (logs.where(F.col("session_id").isNotNull())
            .groupBy("session_id").agg(F.max("created_at").alias("last_accessed"),
                                       F.count("*").alias("accesses")))
    if sessions is None:
        return last
    own = sessions.select("session_id", "ip_address", F.col("last_accessed").alias("_own"))
    return (own.join(last, "session_id", "left")
            .select("session_id", "ip_address", F.coalesce("last_accessed", "_own").alias("last_accessed"),
                    F.coalesce("accesses", F.lit(0)).cast("long").alias("accesses")))


def orphan_datasets(inventory: DataFrame, sessions: DataFrame) -> DataFrame:
    """Stored data sets without a session (reported, never deleted).
    Files are summed per data set first, so the anti join sees one row each."""
    per_ds = inventory.groupBy("session_id").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return (per_ds.join(sessions.select("session_id"), "session_id", "left_anti")
            .withColumn("size_mb", T.bytes_to_mb("bytes")))


def delete_sessions(sessions: DataFrame, logs: DataFrame, doomed: DataFrame,
                    cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """Remove sessions (and, with ``cascade``, their log rows) by anti joins."""
    ids = doomed.select("session_id")
    kept_sessions = sessions.join(ids, "session_id", "left_anti")
    kept_logs = logs.join(ids, "session_id", "left_anti") if cascade else logs
    return kept_sessions, kept_logs


def cleanup_expired(sessions: DataFrame, logs: DataFrame, now: Column,
                    cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """P8 + J9: the expiry clean-up job."""
    return delete_sessions(sessions, logs, sessions.where(is_expired(now)), cascade)


def session_snapshot(sessions: DataFrame, at: Column) -> DataFrame:
    """Sessions existing at ``at``: created by then and not yet cleaned up."""
    return sessions.where((F.col("created_at") <= at) & (F.col("expires_at") > at))


def _lifecycle_data(created: Column) -> Column:
    fmt = "yyyy-MM-dd HH:mm:ss"
    return F.when(created, T.json_object(session_id=F.col("session_id"),
                                         expires_at=F.date_format("expires_at", fmt))).otherwise(
        T.json_object(session_id=F.col("session_id"),
                      created_at=F.date_format("created_at", fmt),
                      last_accessed=F.date_format("last_accessed", fmt)))


def lifecycle_events_between(sessions: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """R5 when both snapshots are one table seen at two times: one scan with two
    membership flags, no join (events stamped ``t2``)."""
    def alive(at: Column) -> Column:
        return (F.col("created_at") <= at) & (F.col("expires_at") > at)
    created = ~alive(t1) & alive(t2)
    deleted = alive(t1) & ~alive(t2)
    return sessions.where(created | deleted).select(
        "session_id", "ip_address",
        F.when(created, F.lit(K.EVENT_SESSION_CREATED))
         .otherwise(F.lit(K.EVENT_SESSION_DELETED)).alias("event_type"),
        _lifecycle_data(created).alias("event_data"),
        F.lit(K.SEVERITY_INFO).alias("severity"),
        t2.alias("created_at"))


def lifecycle_events(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """Created / deleted events from two snapshots, by one full outer join
    on the session id (a session only in ``after`` was created, one only in
    ``before`` was deleted)."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    b = before.select("session_id", F.col("ip_address").alias("_b_ip"),
                      F.col("created_at").alias("_b_created"), F.col("last_accessed").alias("_b_last"),
                      F.lit(True).alias("_in_b"))
    a = after.select("session_id", F.col("ip_address").alias("_a_ip"),
                     F.col("expires_at").alias("_a_exp"), F.lit(True).alias("_in_a"))
    j = b.join(a, "session_id", "full_outer").where(F.col("_in_b").isNull() | F.col("_in_a").isNull())
    created = F.col("_in_b").isNull()
    data = F.when(created, T.json_object(session_id=F.col("session_id"),
                                         expires_at=F.date_format("_a_exp", fmt))).otherwise(
        T.json_object(session_id=F.col("session_id"),
                      created_at=F.date_format("_b_created", fmt),
                      last_accessed=F.date_format("_b_last", fmt)))
    return j.select(
        "session_id",
        F.when(created, F.col("_a_ip")).otherwise(F.col("_b_ip")).alias("ip_address"),
        F.when(created, F.lit(K.EVENT_SESSION_CREATED))
         .otherwise(F.lit(K.EVENT_SESSION_DELETED)).alias("event_type"),
        data.alias("event_data"),
        F.lit(K.SEVERITY_INFO).alias("severity"),
        at.alias("created_at"))
