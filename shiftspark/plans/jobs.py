"""End-to-end jobs: train (E1 / M9), forecast (E2 / M10), clean-up, session info.

Each job is a short chain of the package's lazy operators with explicit
sinks; the driver handles paths and one-row summaries only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T
from shiftspark.operators import audit, features, forecast, model, quality
from shiftspark.sources import csv_ingest, store


@dataclass(frozen=True)
class TrainResult:
    summary: dict
    model_path: str
    schedule_path: str
    profile: dict | None = None


def upload_profile(spark: SparkSession, csv_path: str, schedule: DataFrame) -> DataFrame:
    """Rows, entities and upload MB against the declared limits, one row.
    The size comes from a ``binaryFile`` listing (no content read) as a scalar
    subquery."""
    mb = store.file_listing(spark, csv_path).select(
        T.bytes_to_mb(F.coalesce(F.sum("length"), F.lit(0)))).scalar()
    return quality.dataset_profile(schedule, mb)


def train(spark: SparkSession, csv_path: str, dataset_id: str, schedule_root: str,
          model_root: str, now: Column, mapping: csv_ingest.ColumnMapping = csv_ingest.ColumnMapping(),
          params: model.ForestParams = model.ForestParams(), audit_path: str | None = None,
          ip_address: str = "unknown") -> TrainResult:
    """M9: ingest -> store (replace the data set) -> fit both forests -> save -> log."""
    cleaned = csv_ingest.load_schedule_csv(spark, csv_path, mapping)
    store.save_schedule(cleaned, schedule_root, dataset_id)
    sched = store.read_schedule(spark, schedule_root, dataset_id)
    index = features.id_index(sched)
    fitted = model.fit_models(features.training_frame(sched, index), params)
    summary = model.training_summary(sched, now, params)
    path = f"{model_root.rstrip('/')}/{dataset_id}"
    model.save_models(fitted, index, summary, path)
    info = model.model_info(spark.read.json(f"{path}/summary"))
    profile = upload_profile(spark, csv_path, sched).first().asDict()
    if audit_path:
        event = summary.select(         # the store gives the row its id
            F.lit(None).cast("long").alias("id"), F.lit(dataset_id).alias("session_id"),
            F.lit(ip_address).alias("ip_address"), F.lit(K.EVENT_MODEL_TRAINED).alias("event_type"),
            T.json_object(data_row_count=F.col("data_row_count"),
                          entity_count=F.col("entity_count")).alias("event_data"),
            F.lit(K.SEVERITY_INFO).alias("severity"), now.cast("timestamp_ntz").alias("created_at"))
        store.append_audit_events(event, audit_path)
    return TrainResult(info, path, schedule_root, profile)


def serve(spark: SparkSession, requests: DataFrame, dataset_id: str, schedule_root: str,
          model_root: str) -> tuple[DataFrame, DataFrame]:
    """(forecasts, rejects) for a batch of requests; error if no model is stored."""
    loaded = model.load_models(spark, f"{model_root.rstrip('/')}/{dataset_id}")
    if loaded is None:
        raise LookupError(f"no trained model for data set {dataset_id}")
    fitted, index, _ = loaded
    sched = store.read_schedule(spark, schedule_root, dataset_id)
    return (forecast.forecast(requests, sched, fitted, index),
            forecast.request_rejects(requests, index))


def cleanup(sessions: DataFrame, logs: DataFrame, now: Column, cascade: bool = True,
            sessions_out: str | None = None, logs_out: str | None = None):
    """P8 + J9: remove expired sessions (and their logs); write both tables if asked.

    Outputs go to new paths: a table is never overwritten while being read.
    """
    kept_s, kept_l = audit.cleanup_expired(sessions, logs, now, cascade)
    if sessions_out:
        kept_s.write.mode("overwrite").parquet(sessions_out)
    if logs_out:
        kept_l.write.mode("overwrite").parquet(logs_out)
    return kept_s, kept_l


def session_info(sessions: DataFrame, summaries: DataFrame, now: Column) -> DataFrame:
    """Sessions with their model summary (left join on the data-set id); the
    counts of a session without a model are 0."""
    s = sessions.select(*audit.SESSION_COLS,
                        (F.col("expires_at") <= now).alias("is_expired"))
    m = summaries.withColumnRenamed("dataset_id", "session_id")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("data_row_count", "entity_count") if c in m.columns}
    return s.join(m, "session_id", "left").withColumns(
        {"is_trained": F.coalesce(F.col("is_trained"), F.lit(False))} | counts)
