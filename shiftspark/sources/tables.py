"""Readers for the driver's parquet tables and the derived service tables.

The derived tables (``FIXTURES.md``) are pure projections / aggregates of the
given tables, so their size grows with the input and every operator that reads
them is exercised at the input's scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions.timeparts import expiry_from_creation

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Fixed clock for every audit operator run on the derived tables.
FIXTURE_NOW = "2024-01-31 00:00:00"
# The last order day becomes the day before the fixed clock.
ORDER_SHIFT_DAYS = 8217


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _minute_of_day(ts: str = "ts") -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def schedule_events(events: DataFrame) -> DataFrame:
    """One schedule row per event; (id, date) repeats; ``row_seq`` gives file order."""
    mins = _minute_of_day()
    return (events.where(mins > 0)
            .select(F.col("event_id").alias("row_seq"),
                    F.col("user_id").cast("string").alias(K.ID),
                    F.col("ts").cast("date").alias(K.DATE),
                    mins.cast("double").alias(K.START),
                    (mins + 30 + F.col("event_id") % 400).cast("double").alias(K.END)))


def schedule(events: DataFrame) -> DataFrame:
    """One clean row per (id, day): first and last minute of the day's events."""
    mins = _minute_of_day()
    return (events.groupBy(F.col("user_id").cast("string").alias(K.ID),
                           F.col("ts").cast("date").alias(K.DATE))
            .agg(F.min(mins).alias("_s"), F.max(mins).alias("_e"))
            .where((F.col("_s") > 0) & (F.col("_e") > F.col("_s")))
            .select(K.ID, K.DATE, F.col("_s").cast("double").alias(K.START),
                    F.col("_e").cast("double").alias(K.END)))


def prediction_requests(customer: DataFrame) -> DataFrame:
    """Known and unknown ids, window sizes -1..31 or none, some without a valid
    date, all customers."""
    key = F.col("c_custkey")
    return customer.select(
        key.cast("string").alias(K.ID),
        F.when(key % 41 != 5, F.lit("2024-01-25").cast("date")).alias("target_date"),
        F.when(key % 37 != 1, (key % 33 - 1).cast("int")).alias("window_size"))


def sessions(orders: DataFrame) -> DataFrame:
    """One session per order, moved so that the last ones begin shortly before the
    fixed clock: active and expired ones, some with non-JSON metadata, a malformed
    token, or an expiry before their creation."""
    created = F.col("o_orderdate") + F.make_dt_interval(days=F.lit(ORDER_SHIFT_DAYS))
    token = F.sha2(F.col("o_orderkey").cast("string"), 256)
    bad_meta = F.concat(F.lit("{"), F.lit("'a'"), F.lit(": 1}"))
    return orders.select(
        F.when(F.col("o_orderkey") % 53 == 7, F.substring(token, 1, 63)).otherwise(token).alias("session_id"),
        F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 97).cast("string")).alias("ip_address"),
        created.alias("created_at"),
        (created + F.make_dt_interval(hours=F.lit(9), mins=F.lit(30))).alias("last_accessed"),
        F.when(F.col("o_orderkey") % 59 == 3, created - F.make_dt_interval(days=F.lit(1)))
         .otherwise(expiry_from_creation(created)).alias("expires_at"),
        F.when(F.col("o_orderkey") % 10 == 0, bad_meta).otherwise(F.lit('{"a":1}')).alias("metadata"))


def _ip_of_user(ips: int = 97) -> Column:
    return F.concat(F.lit("10.0.0."), (F.col("user_id") % ips).cast("string"))


def ip_quotas(events: DataFrame) -> DataFrame:
    """One quota row per ip seen in the events (every event counts).

    Users share 89 ips here and sessions have 97, so some session ips have no
    quota row (J7)."""
    return (events
            .groupBy(_ip_of_user(89).alias("ip_address"))
            .agg(F.count("*").alias("requests_count"),
                 F.count_if(F.col("event_type") == "purchase").alias("train_count"),
                 F.count_if(F.col("event_type") == "view").alias("predictions_count"),
                 (F.count_if(F.col("event_type") == "error") % 10).alias("violations_count"),
                 (F.min("user_id") % 4 == 0).alias("is_banned"),
                 F.when(F.min("user_id") % 8 == 0,
                        F.max("ts") + F.make_dt_interval(hours=F.lit(24))).alias("banned_until"),
                 (F.count("*") * 0.5).cast("double").alias("storage_used_mb"),
                 F.max("ts").alias("last_reset"),
                 F.min("ts").alias("created_at")))


def security_logs(events: DataFrame) -> DataFrame:
    """The audit log: one row per event, and a second one for every training,
    which the service logs as JSON and again, up to two minutes later, as text.
    One projection with an explode, so it works on a stream as well."""
    et = F.col("event_type")
    n = F.col("event_id")
    counts = [(n % 50 + 1).cast("string"), (n % 900 + 10).cast("string")]
    trained = F.array(
        F.struct(n.alias("id"), F.concat(F.lit('{"entity_count":'), counts[0], F.lit(',"data_row_count":'), counts[1], F.lit("}")).alias("data"),
                 F.col("ts").alias("at")),
        F.struct((-n - 1).alias("id"), F.concat(F.lit("entities="), counts[0], F.lit(", data_points="), counts[1]).alias("data"),
                 (F.col("ts") + F.make_dt_interval(secs=(n % 120).cast("decimal(18,6)"))).alias("at")))
    other = F.array(F.struct(n.alias("id"), F.col("props").alias("data"), F.col("ts").alias("at")))
    events = events.withColumn("_row", F.explode(F.when(et == "purchase", trained).otherwise(other)))
    return events.select(
        F.col("_row.id").alias("id"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("session_id"),
        _ip_of_user().alias("ip_address"),
        F.when(et == "view", K.EVENT_PREDICTION_MADE)
         .when(et == "click", K.EVENT_SESSION_ACCESSED)
         .when(et == "signup", K.EVENT_SESSION_CREATED)
         .when(et == "purchase", K.EVENT_MODEL_TRAINED)
         .otherwise(K.EVENT_RATE_LIMIT_HIT).alias("event_type"),
        F.col("_row.data").alias("event_data"),
        F.when(et == "error", K.SEVERITY_WARNING).otherwise(K.SEVERITY_INFO).alias("severity"),
        F.col("_row.at").alias("created_at"))


def file_inventory(documents: DataFrame) -> DataFrame:
    """Three files per data set; some data sets have no session."""
    return documents.select(
        F.sha2(((F.col("doc_id") - F.col("doc_id") % 3) * 30).cast("string"), 256).alias("session_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_name"),
        F.col("n_chars").alias("length"))


def admission_events(orders: DataFrame, documents: DataFrame) -> DataFrame:
    """Sessions opened (one per order) and uploads (one per document) of the same ips, one of which
    holds a third of both; some requests have no ip, some uploads are too large."""
    def ip(row: str, key: str) -> Column:
        k = F.col(key)
        return F.when(F.col(row) % 3 == 0, F.lit("10.0.0.7")).when(k % 89 != 5, F.concat(F.lit("10.0.0."), (k % 97).cast("string")))

    opened = orders.select(F.lit("session").alias("kind"), (F.col("o_orderkey") * 2).cast("long").alias("id"), ip("o_orderkey", "o_custkey").alias("ip_address"),
                           (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(ORDER_SHIFT_DAYS))).alias("created_at"),
                           F.lit(None).cast("long").alias("size"))
    day, second = (F.col("doc_id") * 7919 % 2400).cast("int"), (F.col("doc_id") % 86400).cast("decimal(18,6)")
    uploads = documents.select(F.lit("upload").alias("kind"), (F.col("doc_id") * 2 + 1).cast("long").alias("id"), ip("doc_id", "doc_id").alias("ip_address"),
                               (F.lit("2017-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=day, secs=second)).alias("created_at"),
                               (F.col("n_chars") * 8192).cast("long").alias("size"))
    return opened.unionByName(uploads)


class Fixtures:
    """Lazy access to the derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def schedule_events(self) -> DataFrame:
        return schedule_events(self.table("events"))

    def schedule(self) -> DataFrame:
        return schedule(self.table("events"))

    def prediction_requests(self) -> DataFrame:
        return prediction_requests(self.table("customer"))

    def sessions(self) -> DataFrame:
        return sessions(self.table("orders"))

    def ip_quotas(self) -> DataFrame:
        return ip_quotas(self.table("events"))

    def security_logs(self) -> DataFrame:
        return security_logs(self.table("events"))

    def file_inventory(self) -> DataFrame:
        return file_inventory(self.table("documents"))

    def admission_events(self) -> DataFrame:
        return admission_events(self.table("orders"), self.table("documents"))

    def now(self) -> Column:
        return F.lit(FIXTURE_NOW).cast("timestamp_ntz")
