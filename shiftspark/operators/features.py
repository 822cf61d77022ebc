"""Calendar features, entity codes, last record per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T

# monotonically_increasing_id() puts the partition index in the upper 31 bits
# and the row position inside the partition in the lower 33 (its documented
# layout), so both can be read back from the id.
_POS_BITS = 33


def add_features(df: DataFrame, date_col: str = K.DATE) -> DataFrame:
    """M2: the five calendar features of the date column, one narrow projection."""
    d = F.col(date_col)
    return df.select(
        "*",
        T.day_of_week(d).alias(K.DAY_OF_WEEK),
        T.week_of_month(d).alias(K.WEEK_OF_MONTH),
        T.iso_week(d).alias(K.WEEK_OF_YEAR),
        T.month(d).alias(K.MONTH),
        T.day_of_year(d).alias(K.DAY_OF_YEAR))


def id_index(schedule: DataFrame, num_partitions: int | None = None,
             checkpoint: bool = True) -> DataFrame:
    """M1: ``(id, id_encoded)`` with codes 0..n-1 in code-point order of the ids.

    Distributed rank without a single-partition window: the distinct ids are
    range partitioned and sorted, each partition counts its rows, a prefix sum
    over the (few) partition counts gives each partition's offset, and a row's
    code is offset + position.  The tagged ids are written to the shared
    folder, so the codes survive executor loss and later plans see the table's
    true size (for join planning).  With ``checkpoint=False`` they are computed
    twice; positions still agree because the ids are distinct and sorted
    inside each range.
    """
    ids = schedule.select(K.ID).where(F.col(K.ID).isNotNull()).distinct()
    # Without an explicit count AQE may merge adjacent ranges, which keeps order.
    ranged = ids.repartitionByRange(num_partitions, K.ID) if num_partitions else ids.repartitionByRange(K.ID)
    mid = F.monotonically_increasing_id()
    tagged = (ranged.sortWithinPartitions(K.ID)
              .select(K.ID, mid.alias("_mid"))
              .select(K.ID, F.shiftright("_mid", _POS_BITS).alias("_part"),
                      (F.col("_mid") - F.shiftleft(F.shiftright("_mid", _POS_BITS), _POS_BITS))
                      .alias("_pos")))
    if checkpoint:
        # Written to the shared folder and read back: lineage is cut and later
        # joins are planned from the table's real size.
        from shiftspark.session import write_and_read
        tagged = write_and_read(tagged, "id-codes")
    # One row per partition: bounded by n, so the window and broadcast are safe.
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_part")
            .select(K.ID, (F.col("_off") + F.col("_pos")).cast("int").alias(K.ID_ENCODED)))


def encode_ids(df: DataFrame, index: DataFrame, how: str = "inner") -> DataFrame:
    """Attach ``id_encoded``; ``inner`` drops unknown ids, ``left`` keeps them null."""
    return df.join(index, K.ID, how)


def last_record(df: DataFrame, order_col: str = "row_seq",
                keys: tuple[str, ...] = (K.ID, K.DATE)) -> DataFrame:
    """Per key, the values of the row with the largest ``order_col``.

    ``max_by`` is a partial aggregate, so a hot key is combined map-side
    before the shuffle.
    """
    values = [c for c in df.columns if c not in keys and c != order_col]
    picked = F.max_by(F.struct(*values), F.col(order_col)).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])


def training_frame(schedule: DataFrame, index: DataFrame) -> DataFrame:
    """Features + codes for every stored row (duplicates kept, as in training)."""
    return add_features(encode_ids(schedule, index))
