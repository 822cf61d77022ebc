"""The place of every row in an ordered result, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.session import write_and_read

# monotonically_increasing_id(): partition in the upper 31 bits, position in the lower 33.
_POS_BITS = 33


def with_place(ordered: DataFrame, into: str = "place") -> DataFrame:
    """``ordered`` (the result of an ``orderBy``) with each row's place, from 1.

    A global sort leaves ranges in partition order.  The rows are written with their
    partition and position; a place is the rows of the partitions before, plus the position.
    Only one row a partition is summed in order.  Rows that the order does not tell apart
    get places in any order; an empty result has none.
    """
    rows = write_and_read(ordered.select("*", F.monotonically_increasing_id().alias("_at")), "places")
    part = F.shiftright("_at", _POS_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most as many rows as the sort had partitions.
    starts = (rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    place = F.col("_start") + F.col("_at") - F.shiftleft("_part", _POS_BITS) + 1
    return (rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(into, place).drop("_at", "_part", "_start"))
