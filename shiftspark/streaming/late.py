"""T1, T2 with late events: usage counts of a log whose files come in any order.

Every micro-batch is split at the watermark that the batches before it have set: events of
windows that have ended by then are late, the others are on time.  Both are counted, so
nothing is lost: on time + late = all events.  A batch writes three small tables of its own,
named by its number (counts on time, counts late, latest event time), each replaced as a
whole; a batch that runs again after a failure therefore counts once.  What a window holds is
the sum over batches.  ``compact`` adds up the batches so far, so a long-lived stream keeps
one row a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators.quotas import known_ips
from shiftspark.plans.catalog import register
from shiftspark.plans.oracle import with_fixtures as W
from shiftspark.session import path_exists, scratch_dir
from shiftspark.sources.tables import read_table, security_logs

WATERMARK_MINUTES = 10
COUNTS = ["requests", "trainings", "predictions"]


def _counted(rows: DataFrame, window: str) -> DataFrame:
    w = F.window("created_at", window)
    return rows.groupBy("ip_address", w.start.alias("window_start"), w.end.alias("window_end"), "is_late").agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == K.EVENT_MODEL_TRAINED).alias("trainings"),
        F.count_if(F.col("event_type") == K.EVENT_PREDICTION_MADE).alias("predictions"))


class UsageStore:
    """Counts of a stream under one folder, a sub-folder for each micro-batch."""

    def __init__(self, spark: SparkSession, path: str, window: str = "1 hour", watermark_minutes: int = WATERMARK_MINUTES):
        self.spark, self.path, self.window, self.delay = spark, path.rstrip("/"), window, watermark_minutes

    def latest(self, batch_id: int):
        """Latest event time of the batches before ``batch_id``; None before the first one with rows."""
        if batch_id == 0 or not path_exists(self.spark, f"{self.path}/latest/batch={batch_id - 1}"):
            return None
        return self.spark.read.parquet(f"{self.path}/latest/batch={batch_id - 1}").first()[0]

    def write(self, logs: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        before = self.latest(batch_id)
        mark = F.lit(before).cast("timestamp_ntz")
        rows = known_ips(logs).select("ip_address", "event_type", F.col("created_at").cast("timestamp_ntz").alias("created_at")).where("created_at IS NOT NULL")
        ended = F.window("created_at", self.window).end <= mark - F.make_dt_interval(mins=F.lit(self.delay))
        rows = rows.withColumn("_ended", ended) if before is not None else rows.withColumn("_ended", F.lit(False))
        counted = _counted(rows.withColumnRenamed("_ended", "is_late"), self.window)
        counted.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}")
        top = rows.agg(F.max("created_at").alias("latest")).select(F.greatest("latest", mark).alias("latest"))
        top.write.mode("overwrite").parquet(f"{self.path}/latest/batch={batch_id}")

    def usage(self) -> DataFrame:
        """Per ip and window: counts on time and, as ``late_...``, those that came after the window had ended."""
        parts = self.spark.read.parquet(f"{self.path}/counts")
        return parts.groupBy("ip_address", "window_start", "window_end").agg(
            *[F.coalesce(F.sum(F.when(F.col("is_late") == late, F.col(c))), F.lit(0)).cast("long").alias(name + c)
              for late, name in ((False, ""), (True, "late_")) for c in COUNTS])

    def compact(self, path: str) -> DataFrame:
        """The counts so far, added up and written to ``path``: one row a window."""
        self.usage().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def run_usage(logs: DataFrame, store: UsageStore, checkpoint_location: str) -> None:
    """Count all input that is there; run again on the same folders, it goes on where it stopped."""
    (logs.writeStream.foreachBatch(store.write).option("checkpointLocation", checkpoint_location)
     .trigger(availableNow=True).start().awaitTermination())


FILES = 24
ROW_GROUP_BYTES = 4 * 1024 * 1024
_SLOT_S = 30 * 24 * 3600 // FILES


def arrival_file(ts: str = "ts", ident: str = "event_id") -> Column:
    """The file in which an event arrives: that of its time, but every fifth comes one to three files later."""
    slot = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)) / _SLOT_S)
    behind = F.when(F.col(ident) % 5 == 0, F.col(ident) % 3 + 1).otherwise(0)
    return F.least(F.greatest(slot, F.lit(0)) + behind, F.lit(FILES - 1)).cast("int")


def in_files(df: DataFrame, file: Column, name: str) -> str:
    """``df`` as ``FILES`` files by ``file``, written one after the other: the order in which a stream reads them.
    Each has many row groups, so that several tasks read a large one."""
    spark = df.sparkSession
    base = scratch_dir(spark, name)
    df.withColumn("_file", file).repartition(FILES, "_file").write.partitionBy("_file").parquet(f"{base}/dealt")
    dealt = spark.read.parquet(f"{base}/dealt")
    for k in range(FILES):
        dealt.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{base}/arrived")
    return f"{base}/arrived"


def stream_of(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the files of a folder, a file a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@register("stream_usage_late", W(f"""
slots AS (
  SELECT *, CASE WHEN id < 0 THEN -id - 1 ELSE id END AS event_id FROM security_logs),
arrived AS (
  SELECT s.*, least(greatest(CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', e.ts) / {_SLOT_S}.0) AS BIGINT), 0)
                    + CASE WHEN e.event_id % 5 = 0 THEN e.event_id % 3 + 1 ELSE 0 END, {FILES - 1}) AS file
  FROM slots s JOIN events e ON e.event_id = s.event_id),
marks AS (
  SELECT k, (SELECT max(created_at) FROM arrived WHERE file < k) AS latest FROM (SELECT unnest(range({FILES})) AS k)),
judged AS (
  SELECT a.*, coalesce(date_trunc('hour', a.created_at) + INTERVAL 1 HOUR <= m.latest - INTERVAL {WATERMARK_MINUTES} MINUTE, FALSE) AS is_late
  FROM arrived a JOIN marks m ON m.k = a.file)
SELECT ip_address, date_trunc('hour', created_at) AS window_start, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end,
       count(CASE WHEN NOT is_late THEN 1 END) AS requests,
       count(CASE WHEN NOT is_late AND event_type = 'model_trained' THEN 1 END) AS trainings,
       count(CASE WHEN NOT is_late AND event_type = 'prediction_made' THEN 1 END) AS predictions,
       count(CASE WHEN is_late THEN 1 END) AS late_requests,
       count(CASE WHEN is_late AND event_type = 'model_trained' THEN 1 END) AS late_trainings,
       count(CASE WHEN is_late AND event_type = 'prediction_made' THEN 1 END) AS late_predictions
FROM judged GROUP BY ip_address, date_trunc('hour', created_at)""", "security_logs"))
def q_stream_usage_late(spark, sf):
    """24 micro-batches, a file each, a fifth of the events out of time order."""
    logs = security_logs(stream_of(spark, in_files(read_table(spark, sf, "events"), arrival_file(), "late-events")))
    base = scratch_dir(spark, "usage-late")
    store = UsageStore(spark, f"{base}/store")
    run_usage(logs, store, f"{base}/checkpoint")
    return store.usage()
