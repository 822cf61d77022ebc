"""Data-quality checks that the service's triggers and limits state.

Triggers that aborted an insert become a reject-reason column: valid rows and
rejects are split by a filter, nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T

TOKEN_RE = rf"^[0-9a-fA-F]{{{K.TOKEN_LENGTH}}}$"


def session_reject_reason(inserted_at: Column | None = None) -> Column:
    """Why a session row would have been refused, or null.

    ``inserted_at`` defaults to the row's own ``created_at`` (the clock at insert).
    """
    at = F.col("created_at") if inserted_at is None else inserted_at
    return (F.when(~F.col("session_id").rlike(TOKEN_RE), F.lit("bad_token"))
            .when(F.col("expires_at") <= at, F.lit("expiry_not_in_future"))
            .when(~T.is_valid_json("metadata"), F.lit("invalid_metadata_json")))


def session_rejects(sessions: DataFrame) -> DataFrame:
    return (sessions.select("session_id", "ip_address", "created_at", "expires_at", "metadata",
                            session_reject_reason().alias("reason"))
            .where(F.col("reason").isNotNull()))


def valid_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(session_reject_reason().isNull())


def log_retention(logs: DataFrame, now: Column, keep_days: int = K.LOG_RETENTION_DAYS,
                  trigger_rows: int = K.LOG_RETENTION_TRIGGER_ROWS) -> DataFrame:
    """Once the log holds more than ``trigger_rows`` rows, drop rows older
    than ``keep_days``.

    "More than n rows" is an EXISTS over ``offset(n)``: Spark stops reading
    after n + 1 rows instead of counting the whole log.  Those rows carry no
    columns, and their number is bounded by the threshold, not by the log.
    """
    over = logs.offset(trigger_rows).exists()
    return logs.where(~over | (F.col("created_at") >= T.minus_days(now, keep_days)))


def dataset_profile(schedule: DataFrame, size_mb: Column | None = None,
                    limits: dict = K.DEFAULT_QUOTAS) -> DataFrame:
    """Rows, entities (and size) against the declared limits, one row."""
    prof = schedule.agg(F.count("*").alias("data_points"),
                        F.count_distinct(K.ID).alias("entities"))
    out = prof.select(
        "data_points", "entities",
        (F.col("data_points") <= limits["max_data_points"]).alias("within_max_data_points"),
        (F.col("entities") <= limits["max_entities_per_model"]).alias("within_max_entities"))
    if size_mb is not None:
        out = out.withColumn("size_mb", size_mb).withColumn(
            "within_max_file_size", F.col("size_mb") <= limits["max_file_size_mb"])
    return out
