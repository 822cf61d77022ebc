"""Schedule storage and the file inventory of data sets.

Data sets live in one Parquet table partitioned by ``dataset_id``; replacing
one data set is a dynamic partition overwrite, reading one is partition
pruning.  The inventory is a ``binaryFile`` listing that never reads content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftspark import constants as K
from shiftspark.functions.timeparts import bytes_to_mb

SCHEDULE_SCHEMA = T.StructType([
    T.StructField(K.ID, T.StringType()),
    T.StructField(K.DATE, T.DateType()),
    T.StructField(K.START, T.DoubleType()),
    T.StructField(K.END, T.DoubleType()),
    T.StructField("row_seq", T.LongType()),
])

DATASET = "dataset_id"


def save_schedule(schedule: DataFrame, path: str, dataset_id: str | None = None) -> None:
    """Replace the stored schedule (of one data set when ``dataset_id`` is given)."""
    cols = [c for c in SCHEDULE_SCHEMA.fieldNames() if c in schedule.columns]
    # Sorted inside each file (no shuffle): Parquet row-group min/max on id
    # then let entity lookups skip most of the data.
    out = schedule.select(*cols).sortWithinPartitions(K.ID, K.DATE)
    if dataset_id is None:
        out.write.mode("overwrite").parquet(path)
        return
    (out.withColumn(DATASET, F.lit(dataset_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATASET).parquet(path))


def read_schedule(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """Scan the stored schedule; a data set is read by partition pruning."""
    if dataset_id is None:
        return spark.read.schema(SCHEDULE_SCHEMA).parquet(path)
    schema = T.StructType(SCHEDULE_SCHEMA.fields + [T.StructField(DATASET, T.StringType())])
    return (spark.read.schema(schema).parquet(path)
            .where(F.col(DATASET) == dataset_id).drop(DATASET))


def save_datasets(schedule: DataFrame, path: str, dataset_col: str) -> None:
    """S5 for many data sets at once: each value of ``dataset_col`` replaces
    its own partition (dynamic overwrite), the others stay."""
    cols = [c for c in SCHEDULE_SCHEMA.fieldNames() if c in schedule.columns]
    # Rebalanced by data set: a file or few each, and a large one is split by size.
    (schedule.select(*cols, F.col(dataset_col).alias(DATASET))
     .hint("rebalance", DATASET)
     .sortWithinPartitions(DATASET, K.ID, K.DATE)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DATASET).parquet(path))


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """S6 over every data set of the store, with its ``dataset_id``."""
    schema = T.StructType(SCHEDULE_SCHEMA.fields + [T.StructField(DATASET, T.StringType())])
    return spark.read.schema(schema).parquet(path)


def entity_history(schedule: DataFrame, entity_id: str) -> DataFrame:
    """P5: one entity's rows; the predicate reaches the Parquet scan."""
    return schedule.where(F.col(K.ID) == entity_id)


def entities_history(schedule: DataFrame, entities: DataFrame) -> DataFrame:
    """P5 for a batch of entities: a semi join, any number of ids."""
    return schedule.join(entities.select(K.ID), K.ID, "left_semi")


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` with its size; content is never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", "length"))


def dataset_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes and MB per ``dataset_id=`` folder of a partitioned store."""
    files = file_listing(spark, root)
    ds = F.regexp_extract("path", rf"/{DATASET}=([^/]+)/", 1)
    return (files.where(ds != "")
            .groupBy(ds.alias(DATASET))
            .agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
            .withColumn("size_mb", bytes_to_mb("bytes")))


def dataset_rows(spark: SparkSession, root: str) -> DataFrame:
    """S11 with the rows of each data set: counted from file footers' columns only."""
    return read_datasets(spark, root).groupBy(DATASET).agg(F.count("*").alias("rows"))


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """The data-set ids present in the store."""
    return dataset_sizes(spark, root).select(DATASET)


AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_data", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


def audit_rows(events: DataFrame) -> DataFrame:
    """``events`` with the log's columns.  A row without an id gets a random one, so
    that rows of one instant have an order."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT_SCHEMA.fields]
    return events.select(*cols).withColumn("id", F.coalesce("id", F.xxhash64(F.expr("uuid()"))))


def append_audit_events(events: DataFrame, path: str) -> None:
    """Append a batch of audit rows (any number) to the log table."""
    audit_rows(events).write.mode("append").parquet(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a service table bucketed and sorted on its join key.

    Tables bucketed on the same key with the same bucket count join without a
    shuffle (sessions and the audit log on ``session_id``; quotas and
    per-ip aggregates on ``ip_address``).
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
