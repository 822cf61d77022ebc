"""Reading tables and running batch functions for the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from shiftspark.session import ship_package
from shiftspark.sources.tables import read_table

__all__ = ["NO_ID", "keep_texts", "lists_of", "lists_with_edges", "map_batches", "read_table", "sample_rows", "small_batches"]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
                schema: StructType | str) -> DataFrame:
    """``mapInArrow`` of a function that handles one batch at a time; the
    package is shipped to the executors first."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


#: Stands for a null id in joins.
NO_ID = -(1 << 63)


def keep_texts(docs: DataFrame, digest_of: Callable[[pa.Array], pa.Array], listed: DataFrame, how: str,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose (id, digest of the text) is listed (``left_semi``) or not
    (``left_anti``); of rows that repeat both, one.

    ``listed``: id, digest.  Rows travel packed, so their columns may have any
    names, and once: the same distribution serves the join and the choice.
    """
    names = docs.columns
    at = names.index(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield b.append_column("digest", digest_of(b.column("row").field(at)))

    schema = StructType([packed.schema["row"], StructField("id", LongType()), StructField("digest", BinaryType())])
    keys = listed.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), "digest").distinct()
    out = map_batches(packed, run, schema).join(keys, ["id", "digest"], how).dropDuplicates(["id", "digest"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])


def lists_of(table: pa.Table, column: str) -> list[np.ndarray]:
    """The lists of an int32 list column as arrays over one buffer, no Python numbers made."""
    out = []
    for chunk in table.column(column).chunks:
        edge, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [values[a:z] for a, z in zip(edge, edge[1:], strict=False)]
    return out


def lists_with_edges(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of every list (and the end of the last) in the values, and these."""
    edge = lists.offsets.to_numpy()
    return edge - edge[0], lists.values.to_numpy()[edge[0]:edge[-1]]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """For jobs whose rows are large: at most so many in an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sample_rows(spark: SparkSession, df: DataFrame, key: str, label: str, per_class: int, seed: int) -> DataFrame:
    """At most about ``per_class`` rows of each value of ``label``, chosen by a
    seeded hash of ``key``: each class is thinned by its own rate, from counts
    over all rows.  Classes are few (labels), so the counts fit a literal."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    # 53 bits of the hash as a number in [0, 1).
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    keep = F.lit(False)
    for value, n in counts.items():
        if value is not None:
            keep = keep | ((F.col(label) == F.lit(value)) & (u < min(1.0, per_class / n)))
    return df.where(keep)
