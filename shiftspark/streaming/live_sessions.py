"""T4, J8 with sessions that open while the log flows: a join of two streams.

Sessions and log rows each come as a stream with a watermark.  A log row meets its session
if it lies in the session's life, which begins at its creation and lasts at most
``SESSION_LIFETIME_DAYS``.  That bound is part of the join condition, so Spark knows when no
row of either side can meet another one any more and drops it from the state: a session
after its life, a log row once sessions that were created before it cannot come any more.
State lies in partitions by session id; sessions are many, so no key is hot, and a log row
without a session costs its own row for the length of the delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T
from shiftspark.plans.catalog import REGISTRY, register
from shiftspark.sources.tables import ORDER_SHIFT_DAYS, read_table, security_logs, sessions
from shiftspark.streaming import late
from shiftspark.streaming import usage  # noqa: F401  (its queries' SQL)

DELAY = "30 days"
#: Rows of both streams for each state partition, where they are more than the cores need.
STATE_ROWS = 2_000_000


def ip_changes(logs: DataFrame, opened: DataFrame, delay: str = DELAY) -> DataFrame:
    """``ip_changed`` events of two streams: accesses of a live session from another ip.

    ``delay``: how far behind the latest row of its stream a row may come; the slower stream
    sets the pace for both.  Rows without an ip, or a session without one, are no change, as in
    the batch form.
    """
    log = (logs.select("id", F.col("session_id").alias("_of"), "ip_address", "created_at", T.wall_clock_to_instant("created_at").alias("at"))
           .withWatermark("at", delay))
    session = (opened.select("session_id", F.col("ip_address").alias("old_ip"), T.wall_clock_to_instant("created_at").alias("opened_at"),
                             T.wall_clock_to_instant("expires_at").alias("ends_at"))
               .withWatermark("opened_at", delay))
    alive = ((F.col("_of") == F.col("session_id")) & (F.col("at") >= F.col("opened_at")) & (F.col("at") <= F.col("ends_at"))
             & (F.col("at") <= F.col("opened_at") + F.make_dt_interval(days=F.lit(K.SESSION_LIFETIME_DAYS))))
    data = F.concat(F.lit('{"old_ip": '), T.json_text("old_ip"), F.lit(', "new_ip": '), T.json_text("ip_address"), F.lit("}"))
    return (log.join(session, alive).where(F.col("ip_address") != F.col("old_ip"))
            .select(F.col("id").alias("access_id"), "session_id", "ip_address", "old_ip", F.lit(K.EVENT_IP_CHANGED).alias("event_type"),
                    data.alias("event_data"), F.lit(K.SEVERITY_WARNING).alias("severity"), "created_at"))


def _session_file(first: str = "2017-01-01 00:00:00", days: int = 2600) -> Column:
    """The file in which a session arrives: by its creation."""
    day = F.date_diff(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(ORDER_SHIFT_DAYS)), F.lit(first).cast("timestamp_ntz"))
    slot = F.floor(day * late.FILES / days)
    return F.least(F.greatest(slot, F.lit(0)), F.lit(late.FILES - 1)).cast("int")


def state_partitions(spark: SparkSession, rows: int) -> int:
    """State partitions of a join that sees ``rows`` rows: one a core, and more as the rows grow."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))


@register("stream_ip_changes_live", REGISTRY["stream_ip_changes"].sql)
def q_stream_ip_changes_live(spark, sf):
    """24 files each of sessions and of the log, a fifth of whose events comes out of time order."""
    orders, events = read_table(spark, sf, "orders"), read_table(spark, sf, "events")
    opened = late.stream_of(spark, late.in_files(orders, _session_file(), "live-orders"))
    logs = late.stream_of(spark, late.in_files(events, late.arrival_file(), "live-events"))
    return usage.run_to_table(ip_changes(security_logs(logs), sessions(opened)), "ip-changes-live",
                              state_partitions=state_partitions(spark, orders.count() + events.count()))
