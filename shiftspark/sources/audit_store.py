"""The audit log stored by day, so that retention drops days instead of rewriting rows.

The log is a Parquet table partitioned by ``day`` (the UTC day of ``created_at``).  Cleaning it
up deletes the folders of whole days before the border, and rewrites the border's day alone:
the other days' files are neither read nor touched.  Whether the log is large enough to be
cleaned at all is a count without columns, which Parquet answers from file footers.

Defined cases: rows without a time stand in a partition of their own, and are never younger
than a border, so a clean-up drops them.  A clean-up that was interrupted is simply run
again.  One writer cleans at a time, as one scheduler job does; rows of later days may be
appended meanwhile.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftspark import constants as K
from shiftspark.session import write_and_read
from shiftspark.sources.store import AUDIT_SCHEMA, audit_rows

DAY = "day"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def append_by_day(events: DataFrame, path: str) -> None:
    """S7 into the log by day: a file or few for each day; a large day is split by size."""
    rows = audit_rows(events).withColumn(DAY, F.to_date("created_at"))
    # The ids are written here; a lost task draws those of its rows again before any is committed.
    rows.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    """The stored log with its ``day``; a condition on it prunes partitions."""
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField(DAY, T.DateType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def stored_days(spark: SparkSession, path: str) -> dict[dt.date | None, str]:
    """The log's days and their folders (None: rows without a time); as many as days were kept."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = {}
    for status in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{DAY}="):
            value = name[len(DAY) + 1:]
            found[None if value == _NO_DAY else dt.date.fromisoformat(value)] = f"{path.rstrip('/')}/{name}"
    return found


def _remove(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def border_rows(spark: SparkSession, path: str, border: dt.datetime) -> DataFrame:
    """What stays of the border's day: the only rows that a clean-up reads."""
    log = read_by_day(spark, path).where(F.col(DAY) == F.lit(border.date()))
    return log.where(F.col("created_at") >= F.lit(border).cast("timestamp_ntz"))


def clean_by_day(spark: SparkSession, path: str, now: Column, keep_days: int = K.LOG_RETENTION_DAYS,
                 trigger_rows: int = K.LOG_RETENTION_TRIGGER_ROWS) -> tuple[list[dt.date | None], dt.date | None]:
    """P16 in place: (days dropped whole, the day rewritten), both empty if the log is no longer than ``trigger_rows``."""
    days = stored_days(spark, path)
    if not days or read_by_day(spark, path).count() <= trigger_rows:
        return [], None
    border = spark.range(1).select((now.cast("timestamp_ntz") - F.expr(f"INTERVAL {keep_days} DAYS")).alias("b")).first()[0]
    rewritten = None
    gone = [d for d in days if d is None or d < border.date()]
    if border.date() in days and border.time() != dt.time():
        # Written apart first, so the day's own files stay until the new ones are complete.
        rows = write_and_read(border_rows(spark, path, border), "border-day")
        if rows.isEmpty():
            gone.append(border.date())
        else:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
            rewritten = border.date()
    for day in gone:
        _remove(spark, days[day])
    return sorted(gone, key=lambda d: d or dt.date.min), rewritten
