"""Folds over an ip's events in order, without an ip ever standing in one task.

The service keeps one number an ip and changes it request by request: a counter that
never falls below zero (A11, F22), storage that a refused upload does not use (A15),
models (A16), and violations that end in a ban (R3).  Such folds are not plain running
sums.  Here events are sorted by range over (ip, time, id) into chunks, so a hot ip has
many chunks, and each fold is brought down to sums and minima that chunks hand on:

* ``floored_counter``: the counter after event i is S(i) - min(0, S(1), ..., S(i)) for the
  plain running sum S.  A chunk hands on its sum and its least running sum.
* ``admit``: greedy admission under a limit, level by level.  With r left and T = r div 2,
  as long as more than T is left every item up to T fits and nothing above r does; one item
  between them that still fits leaves at most T.  So a level ends at the first event where
  the sum of items up to T reaches r - T, or where a larger one fits what is left; that is
  one running sum, and r at least halves.  The levels of an ip are at most the binary digits
  of its limit, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T
from shiftspark.operators.quotas import known_ips, nth_per_group
from shiftspark.session import write_and_read

_AT = ["created_at", "id"]
_MB = int(T.BYTES_PER_MB)


def in_chunks(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``events`` written in ranges of (keys, order), with ``chunk`` (ranges ascend): a key with
    many rows has many chunks."""
    dealt = events.repartitionByRange(*keys, *order).withColumn("chunk", F.spark_partition_id())
    return write_and_read(dealt, "chunks")


def floored_counter(events: DataFrame, key: str, order: list[str], delta: str, into: str) -> DataFrame:
    """``events`` with ``into``: the key's counter after each event, which adds ``delta`` and never
    leaves the counter below zero.  ``order`` must tell a key's events apart."""
    c = in_chunks(events, [key], order)
    so_far = Window.partitionBy(key, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_sum", F.sum(delta).over(so_far))
    c = c.withColumn("_min", F.min("_sum").over(so_far))
    # One row a key and chunk: what the chunks before hand on.
    ends = c.groupBy(F.col(key).alias("_key"), F.col("chunk").alias("_chunk")).agg(F.sum(delta).alias("_total"), F.min("_sum").alias("_least"))
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ends = ends.withColumn("_start", F.coalesce(F.sum("_total").over(before), zero))
    ends = ends.withColumn("_low", F.least(zero, F.min(F.col("_start") + F.col("_least")).over(before))).select("_key", "_chunk", "_start", "_low")
    out = c.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    low = F.least(F.col("_low"), F.col("_start") + F.col("_min"))
    return out.withColumn(into, F.col("_start") + F.col("_sum") - low).drop("chunk", "_sum", "_min", "_key", "_chunk", "_start", "_low")


def models_counter(sessions: DataFrame, now: Column) -> DataFrame:
    """A11 as it is maintained: one row for every creation and every deletion (at expiry, up to
    ``now``), with the ip's counter after it.

    At one instant creations come first.  A deletion before its creation finds the counter at
    zero and leaves it there, so the counter can stay above the number of live sessions.
    """
    s = known_ips(sessions).select("session_id", "ip_address", "created_at", "expires_at")
    made = s.select("session_id", "ip_address", "created_at", F.lit(1).cast("long").alias("delta"))
    gone = s.where(F.col("expires_at") <= now).select("session_id", "ip_address", F.col("expires_at").alias("created_at"), F.lit(-1).cast("long").alias("delta"))
    events = made.unionByName(gone).withColumn("_first", -F.col("delta"))
    return (floored_counter(events, "ip_address", ["created_at", "_first", "session_id"], "delta", "models_count")
            .select("session_id", "ip_address", "created_at", "delta", "models_count"))


def _is_after(at: str, ident: str) -> Column:
    return (F.col("created_at") > F.col(at)) | ((F.col("created_at") == F.col(at)) & (F.col("id") > F.col(ident)))


def admit(items: DataFrame, limit: int) -> DataFrame:
    """``items`` (ip_address, created_at, id, size) with ``fits``: whether the item was let in, in the
    order of (created_at, id), given that what was let in before it stays and the total may not pass
    ``limit``.  Sizes are whole and not negative."""
    c = in_chunks(items, ["ip_address"], _AT)
    first = c.groupBy("ip_address").agg(F.min(F.struct(*_AT)).alias("f"))
    now = first.select("ip_address", F.lit(0).alias("level"), F.lit(limit).cast("long").alias("left"),
                       F.col("f.created_at").alias("from_at"), F.col("f.id").alias("from_id"), F.lit(True).alias("from_first"))
    so_far = Window.partitionBy("ip_address", "chunk").orderBy(*_AT).rowsBetween(Window.unboundedPreceding, -1)
    chunks_before = Window.partitionBy("_ip").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    small = F.col("size") <= F.floor(F.col("left") / 2)
    zero = F.lit(0).cast("long")
    now = write_and_read(now, "levels")
    levels = None
    level = 0
    while True:
        # The rows from which the level starts on: its own start only in the first level.
        open_ = c.join(now, "ip_address").where(_is_after("from_at", "from_id") | (F.col("from_first") & (F.col("created_at") == F.col("from_at")) & (F.col("id") == F.col("from_id"))))
        open_ = open_.withColumn("_take", F.when(small, F.col("size")).otherwise(zero))
        open_ = open_.withColumn("_before", F.coalesce(F.sum("_take").over(so_far), zero))
        offsets = (open_.groupBy(F.col("ip_address").alias("_ip"), F.col("chunk").alias("_chunk")).agg(F.sum("_take").alias("_total"))
                   .withColumn("_start", F.coalesce(F.sum("_total").over(chunks_before), zero)).drop("_total"))
        held = F.col("_start") + F.col("_before")
        ends = F.when(small, held + F.col("size") >= F.col("left") - F.floor(F.col("left") / 2)).otherwise(F.col("size") <= F.col("left") - held)
        end = (open_.join(offsets, (F.col("ip_address") == F.col("_ip")) & (F.col("chunk") == F.col("_chunk")))
               .where((F.col("left") > 0) & ends).groupBy("ip_address").agg(F.min(F.struct(*_AT, (F.col("left") - held - F.col("size")).alias("rest"))).alias("e")))
        done = write_and_read(now.join(end, "ip_address", "left").select(
            "ip_address", "level", "left", F.col("e.created_at").alias("to_at"), F.col("e.id").alias("to_id"), F.col("e.rest").alias("rest")), "levels")
        levels = done if levels is None else levels.unionByName(done)
        level += 1
        now = done.where(F.col("to_at").isNotNull()).select(
            "ip_address", F.lit(level).alias("level"), F.col("rest").alias("left"), F.col("to_at").alias("from_at"), F.col("to_id").alias("from_id"), F.lit(False).alias("from_first"))
        # With nothing left, a level has no end: only empty items fit.
        if now.where("left > 0").isEmpty():
            levels = levels.unionByName(now.select("ip_address", "level", "left", F.lit(None).cast(done.schema["to_at"].dataType).alias("to_at"),
                                                   F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("long").alias("rest")))
            break
    # At most the digits of the limit, and one: the levels of an ip as one array.
    per_ip = write_and_read(levels.groupBy("ip_address").agg(F.sort_array(F.collect_list(F.struct("level", "left", "to_at", "to_id"))).alias("levels")), "levels-per-ip")
    own = F.filter("levels", lambda v: v["to_at"].isNull() | (v["to_at"] > F.col("created_at")) | ((v["to_at"] == F.col("created_at")) & (v["to_id"] >= F.col("id"))))[0]
    out = c.join(per_ip, "ip_address").withColumn("_level", own)
    at_end = (F.col("_level.to_at") == F.col("created_at")) & (F.col("_level.to_id") == F.col("id"))
    fits = (F.col("size") <= F.floor(F.col("_level.left") / 2)) | F.coalesce(at_end, F.lit(False))
    return out.withColumn("fits", fits).drop("chunk", "levels", "_level")


def _decided(events: DataFrame, limits: dict) -> DataFrame:
    """``events`` with ``outcome`` if no ip were ever banned: accepted, models, storage or too_large."""
    most = limits["max_file_size_mb"] * _MB
    uploads = events.where((F.col("kind") == "upload") & (F.col("size") <= most))
    reserved = uploads.withColumn("size", F.col("size") * K.UPLOAD_STORAGE_FACTOR)
    stored = admit(reserved, limits["max_storage_per_ip_mb"] * _MB)
    stored = stored.withColumn("size", F.floor(F.col("size") / K.UPLOAD_STORAGE_FACTOR)).withColumn(
        "outcome", F.when(F.col("fits"), F.lit("accepted")).otherwise(F.lit("storage"))).drop("fits")
    large = events.where((F.col("kind") == "upload") & (F.col("size") > most)).withColumn("outcome", F.lit("too_large"))
    opened = events.where(F.col("kind") == "session")
    if limits["models_per_ip"] <= 0:
        opened = opened.withColumn("outcome", F.lit("models"))
    else:
        last = write_and_read(nth_per_group(opened, ["ip_address"], limits["models_per_ip"], "_m"), "last-model")
        opened = opened.join(last, "ip_address", "left").withColumn(
            "outcome", F.when(F.col("_m_ts").isNotNull() & _is_after("_m_ts", "_m_id"), F.lit("models")).otherwise(F.lit("accepted"))).drop("_m_ts", "_m_id")
    return stored.unionByName(large).unionByName(opened)


def quota_admission(events: DataFrame, limits: dict = K.DEFAULT_QUOTAS) -> DataFrame:
    """A15, A16 -> R3: every session opened and every upload of an ip, decided in order.

    ``events``: kind (session or upload), id, ip_address, created_at, size (bytes; uploads).
    ``outcome``: accepted; models (the ip has its models); storage (the upload, reserved
    ``UPLOAD_STORAGE_FACTOR`` times, would pass the ip's storage); too_large (refused before
    anything counts); banned (refused while the ban lasts, before anything counts).  What is
    refused takes no room.  ``models`` and ``storage`` are violations, and the
    ``ban_after_violations``-th bans the ip, once, for ``ban_duration_hours``.

    Ids tell the events of an ip apart at one instant.  Until its ban an ip is decided as if
    there were none, so the first pass finds every ban, and the second decides the banned ips
    again without the events that the ban refuses.
    """
    events = known_ips(events).withColumn("size", F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long"))
    first = write_and_read(_decided(events, limits), "admission")
    after = max(1, limits["ban_after_violations"])
    ban = nth_per_group(first.where(F.col("outcome").isin("models", "storage")), ["ip_address"], after, "_b")
    ban = write_and_read(ban.withColumn("_until", T.plus_hours("_b_ts", limits["ban_duration_hours"])), "admission-bans")
    banned = write_and_read(first.drop("outcome").join(ban, "ip_address").withColumn(
        "_refused", _is_after("_b_ts", "_b_id") & (F.col("created_at") < F.col("_until"))), "banned-events")
    cols = [*events.columns, "outcome"]
    again = _decided(banned.where("NOT _refused").select(*events.columns), limits).select(*cols)
    refused = banned.where("_refused").withColumn("outcome", F.lit("banned")).select(*cols)
    return first.join(ban.select("ip_address"), "ip_address", "left_anti").select(*cols).unionByName(again).unionByName(refused)


def admission_per_ip(decided: DataFrame, limits: dict = K.DEFAULT_QUOTAS) -> DataFrame:
    """Per ip: counts by outcome, MB stored, violations, and the ban."""
    after = max(1, limits["ban_after_violations"])
    wrong = F.col("outcome").isin("models", "storage")
    ban = nth_per_group(decided.where(wrong), ["ip_address"], after, "_b").select(
        "ip_address", F.col("_b_ts").alias("banned_at"), T.plus_hours("_b_ts", limits["ban_duration_hours"]).alias("banned_until"))
    stored = F.sum(F.when((F.col("outcome") == "accepted") & (F.col("kind") == "upload"), F.col("size")).otherwise(0)) * K.UPLOAD_STORAGE_FACTOR
    return (decided.groupBy("ip_address").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "models", "storage", "too_large", "banned")],
        F.count_if(wrong).alias("violations"), T.bytes_to_mb(stored).alias("storage_mb"))
        .join(ban, "ip_address", "left"))
