"""The audit log as a stream.

The log is read with ``readStream`` (a file source over the events table),
mapped to audit rows exactly as in batch, and

* T1/T2: counted per ip and tumbling window after a watermark, emitted in
  append mode when a window closes, with violations over a per-window limit;
* T4: joined to the static session table (stream-static join, no state) to
  emit ``ip_changed`` events.

``run_to_table`` drives a query to completion with ``availableNow`` into a
Parquet sink under the shared checkpoint folder and returns the sink as a
batch DataFrame, so a registered query can be checked like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions.timeparts import instant_to_wall_clock, wall_clock_to_instant
from shiftspark.operators import quotas
from shiftspark.plans.catalog import register
from shiftspark.plans.oracle import with_fixtures as W
from shiftspark.session import is_folder, scratch_dir, ship_package
from shiftspark.sources.tables import Fixtures, read_table, security_logs

WATERMARK = "10 minutes"
# Micro-batches of a deployed stream read at most this many new files, which
# bounds the rows a window aggregation sees; its files must come in time order.
# Registered queries read a bounded table in one micro-batch (None), so neither
# the watermark nor an ip's order depends on how rows lie in its files.
FILES_PER_TRIGGER = 8


def read_events_stream(spark: SparkSession, sf_dir: str,
                       files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """The events table as a file stream (schema taken from the batch table): a
    folder of part files, or a single file.  A table without any file raises."""
    table = read_table(spark, sf_dir, "events")
    if not table.inputFiles():
        raise FileNotFoundError(f"no events under {sf_dir}")
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    # A file source watches a folder; the glob keeps it to the one file.
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/"))


def log_stream(spark: SparkSession, sf_dir: str,
               files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    return security_logs(read_events_stream(spark, sf_dir, files_per_trigger))


def usage_stream(logs: DataFrame, window: str = "1 hour", request_limit: int | None = None,
                 watermark: str = WATERMARK) -> DataFrame:
    """T1 (+T2 when ``request_limit`` is given): per-window counts, append mode.

    The watermark needs a zoned timestamp: the wall-clock event time is read
    as UTC (independent of the session zone) and window bounds are turned back
    into wall-clock timestamps, so windows align exactly as in batch.
    """
    ts = wall_clock_to_instant("created_at")
    w = F.window("event_time", window)
    agg = (quotas.known_ips(logs).withColumn("event_time", ts)
           .withWatermark("event_time", watermark)
           .groupBy("ip_address", w.alias("w"))
           .agg(F.count("*").alias("requests"),
                F.count_if(F.col("event_type") == K.EVENT_MODEL_TRAINED).alias("trainings"),
                F.count_if(F.col("event_type") == K.EVENT_PREDICTION_MADE).alias("predictions")))
    out = agg.select("ip_address",
                     instant_to_wall_clock("w.start").alias("window_start"),
                     instant_to_wall_clock("w.end").alias("window_end"),
                     "requests", "trainings", "predictions")
    if request_limit is not None:
        out = out.withColumn("violations",
                             F.greatest(F.col("requests") - F.lit(request_limit), F.lit(0)))
    return out


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", state_partitions: int | None = None) -> DataFrame:
    """Run a streaming query until the available input is consumed; read its sink.

    Every micro-batch opens and commits the stores of every state partition, even of those that
    get no row; ``state_partitions`` sets their number (else the session's shuffle partitions).
    """
    spark = df.sparkSession
    base = scratch_dir(spark, f"stream-{name}")
    writer = (df.writeStream.format("parquet").outputMode(output_mode)
              .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
              .trigger(availableNow=True))
    conf = "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    try:
        # A query takes the session's settings as they are when it starts.
        spark.conf.set(conf, state_partitions or before)
        query = writer.start()
    finally:
        spark.conf.set(conf, before)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def start_to_parquet(df: DataFrame, path: str, checkpoint_location: str,
                     processing_time: str = "1 minute", output_mode: str = "append"):
    """Deploy a streaming query for good: a Parquet sink, a checkpoint on
    shared storage (restart resumes from it) and a processing-time trigger.
    Returns the running ``StreamingQuery``."""
    return (df.writeStream.format("parquet").outputMode(output_mode)
            .option("path", path).option("checkpointLocation", checkpoint_location)
            .trigger(processingTime=processing_time).start())


STREAM_REQUEST_LIMIT = 5


@register("stream_usage_by_window", W(f"""
SELECT ip_address, date_trunc('hour', created_at) AS window_start,
       date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end,
       count(*) AS requests,
       count(CASE WHEN event_type = 'model_trained' THEN 1 END) AS trainings,
       count(CASE WHEN event_type = 'prediction_made' THEN 1 END) AS predictions,
       greatest(count(*) - {STREAM_REQUEST_LIMIT}, 0) AS violations
FROM security_logs GROUP BY ip_address, date_trunc('hour', created_at)
HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR
       <= (SELECT max(created_at) FROM security_logs) - INTERVAL 10 MINUTE""", "security_logs"))
def q_stream_usage_by_window(spark, sf):
    return run_to_table(usage_stream(log_stream(spark, sf, None), "1 hour", STREAM_REQUEST_LIMIT),
                        "usage")


@register("stream_ip_changes", W("""
SELECT l.id AS access_id, l.session_id, l.ip_address, s.ip_address AS old_ip,
       'ip_changed' AS event_type,
       '{"old_ip": "' || s.ip_address || '", "new_ip": "' || l.ip_address || '"}' AS event_data,
       'WARNING' AS severity, l.created_at
FROM security_logs l JOIN sessions s ON l.session_id = s.session_id
WHERE l.created_at >= s.created_at AND l.created_at <= s.expires_at
  AND l.ip_address <> s.ip_address""", "security_logs", "sessions"))
def q_stream_ip_changes(spark, sf):
    return ip_change_stream(spark, sf, Fixtures(spark, sf).sessions())


def ip_change_stream(spark: SparkSession, sf_dir: str, sessions: DataFrame) -> DataFrame:
    """T4: the static side is projected and persisted once for the life of the
    stream, so micro-batches do not recompute it; it is released afterwards."""
    static = sessions.select("session_id", "ip_address", "created_at", "expires_at").persist()
    try:
        return run_to_table(quotas.ip_changes(log_stream(spark, sf_dir), static), "ip-changes")
    finally:
        static.unpersist()


def _stream_bans_sql() -> str:
    from shiftspark.plans.catalog import REGISTRY
    return REGISTRY["bans"].sql


@register("stream_bans", _stream_bans_sql())
def q_stream_bans(spark, sf):
    """Stateful per-ip decisions on the stream; summarised like batch ``bans``."""
    from shiftspark.plans.catalog import FIXTURE_BAN_AFTER, FIXTURE_BAN_HOURS, FIXTURE_LIMITS
    from shiftspark.streaming import bans as SB
    ship_package(spark)
    decisions = run_to_table(SB.ban_decisions(log_stream(spark, sf, None), FIXTURE_LIMITS,
                                              FIXTURE_BAN_AFTER, FIXTURE_BAN_HOURS), "bans")
    return SB.bans_from_decisions(decisions, FIXTURE_BAN_AFTER, FIXTURE_BAN_HOURS)
