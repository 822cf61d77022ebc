"""Exact dedup with a cuckoo-filter index of live digests.

Every text is reduced to the SHA-256 of its normalised form (A-Z lower-cased;
null counts as empty).  A ``CuckooIndex`` holds the live digests: a cuckoo
filter of 16-bit fingerprints (four slots a bucket, two candidate buckets) in
front of the bucketed content, which is the whole digest and the text's length.
A fingerprint hit counts only if that content is equal.  When an insertion
overflows (too many displacements) the filter doubles and is refilled from the
stored keys.  A key can be deleted, and its slot used again.

Dedup runs two rounds of such indexes and never moves a text:

1. each partition of the input feeds its own index, a run of rows at a time, and
   gives one row for each digest it saw: count and largest id.  A group of
   copies that holds a third of all rows shrinks here to one row a partition.
2. those rows are dealt out by digest, and an index for each shuffle partition
   merges them: the entry of a later id replaces the live one (delete, insert).

Memory is that of the distinct digests of one partition (some 250 bytes each, as measured);
``partitions`` spreads them further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.common import keep_texts, map_batches, read_table
from shiftspark.session import ship_package, write_and_read

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests with a value each; insertion, lookup, deletion, resizing.

    Keys are 32-byte digests and an integer length; values are (largest id,
    count).  Slots hold the fingerprint and the row of the stored key.
    """

    def __init__(self, buckets: int = 256, max_kicks: int = MAX_KICKS):
        self.max_kicks = max_kicks
        self.keys: list[tuple[bytes, int] | None] = []
        self.best: list = []
        self.count: list[int] = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.rows = [-1] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    @staticmethod
    def _print(key: tuple[bytes, int]) -> int:
        return int.from_bytes(key[0][8:10], "little") or 1

    def _buckets(self, key: tuple[bytes, int], fp: int) -> tuple[int, int]:
        a = int.from_bytes(key[0][:8], "little") & self.mask
        return a, self._other(a, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995 >> 7)) & self.mask

    def _slot(self, key: tuple[bytes, int]) -> int:
        """The slot whose fingerprint and stored content are the key's; -1 if none."""
        fp = self._print(key)
        for b in self._buckets(key, fp):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == fp and self.keys[self.rows[s]] == key:
                    return s
        return -1

    def get(self, key: tuple[bytes, int]) -> tuple | None:
        s = self._slot(key)
        return None if s < 0 else (self.best[self.rows[s]], self.count[self.rows[s]])

    def insert(self, key: tuple[bytes, int], best, count: int = 1) -> None:
        """Add a key that is not in the index."""
        if self.free:
            row = self.free.pop()
            self.keys[row], self.best[row], self.count[row] = key, best, count
        else:
            row = len(self.keys)
            self.keys.append(key)
            self.best.append(best)
            self.count.append(count)
        if not self._place(self._print(key), row):
            self._grow()

    def _place(self, fp: int, row: int) -> bool:
        a, b = self._buckets(self.keys[row], fp)
        for bucket in (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.rows[s] < 0:
                    self.prints[s], self.rows[s] = fp, row
                    return True
        bucket = b
        for kick in range(self.max_kicks):
            s = bucket * SLOTS + (kick * 7 + fp) % SLOTS
            fp, self.prints[s] = self.prints[s], fp
            row, self.rows[s] = self.rows[s], row
            bucket = self._other(bucket, fp)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.rows[s] < 0:
                    self.prints[s], self.rows[s] = fp, row
                    return True
        return False

    def _grow(self) -> None:
        """Double the filter and refill it from the stored keys, till all fit."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(self._print(k), row) for row, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: tuple[bytes, int]) -> tuple | None:
        """Remove a key; its value, or None if it is not in the index."""
        s = self._slot(key)
        if s < 0:
            return None
        row = self.rows[s]
        value = self.best[row], self.count[row]
        self.prints[s], self.rows[s] = 0, -1
        self.keys[row] = None
        self.free.append(row)
        return value

    def merge(self, key: tuple[bytes, int], best, count: int = 1) -> bool:
        """Count ``count`` more copies; the larger id is the live one.  True for a new key."""
        live = self.get(key)
        if live is None:
            self.insert(key, best, count)
            return True
        old, n = live
        if best is not None and (old is None or best > old):
            self.delete(key)
            self.insert(key, best, n + count)
        else:
            self.count[self.rows[self._slot(key)]] = n + count
        return False

    def items(self) -> Iterator[tuple[tuple[bytes, int], object, int]]:
        for key, best, n in zip(self.keys, self.best, self.count, strict=True):
            if key is not None:
                yield key, best, n


def normal_bytes(text: bytes | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased; other letters have no byte below 128."""
    return (text or b"").translate(_FOLD)


def _digest_column(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    norm = [normal_bytes(t) for t in texts.cast(pa.binary()).to_pylist()]
    return (pa.array([hashlib.sha256(t).digest() for t in norm], pa.binary()),
            pa.array([len(t) for t in norm], pa.int32()))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (32 bytes) and byte length of every row's normalised text."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column(0), *_digest_column(b.column(1))], names=["id", "digest", "size"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run,
                       "id long, digest binary, size int")


_INDEX_SCHEMA = "digest binary, size int, best long, copies long"


def _columns(rows: Iterable[tuple]) -> pa.RecordBatch:
    d, s, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(s, pa.int32()), pa.array(b, pa.int64()),
                                       pa.array(c, pa.int64())], names=["digest", "size", "best", "copies"])


def _index_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One cuckoo index over all rows of the partition."""
    index = CuckooIndex()
    for b in batches:
        for d, s, best, n in zip(*(b.column(c).to_pylist() for c in ("digest", "size", "best", "copies")), strict=True):
            index.merge((d, s), best, n)
    out = []
    for (d, s), best, n in index.items():
        out.append((d, s, best, n))
        if len(out) == 50_000:
            yield _columns(out)
            out = []
    if out:
        yield _columns(out)


def build_index(digest_rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """digest, size, best (largest id), copies: one row a distinct text."""
    spark = digest_rows.sparkSession
    ship_package(spark)
    one = digest_rows.select("digest", "size", F.col("id").alias("best"), F.lit(1).cast("long").alias("copies"))
    local = one.mapInArrow(_index_partition, _INDEX_SCHEMA)
    dealt = local.repartition(partitions, "digest") if partitions else local.repartition("digest")
    return dealt.mapInArrow(_index_partition, _INDEX_SCHEMA)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The index after deleting the digests of ``removed`` and inserting ``added``.

    Both are tables of ``digests()``.  A deleted digest loses all its copies; a
    digest in both tables is deleted first.  Deleting one that is not there does
    nothing.
    """
    spark = index.sparkSession
    ship_package(spark)
    new = build_index(added, partitions)
    gone = removed.select("digest", "size", F.lit(None).cast("long").alias("best"), F.lit(-1).cast("long").alias("copies"))
    rows = (index.select("digest", "size", "best", "copies", F.lit(0).alias("step"))
            .union(gone.dropDuplicates(["digest", "size"]).withColumn("step", F.lit(1)))
            .union(new.withColumn("step", F.lit(2))))
    dealt = rows.repartition(partitions, "digest") if partitions else rows.repartition("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for b in batches:
            for d, s, best, n, step in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if step == 1:
                    live.delete((d, s))
                else:
                    live.merge((d, s), best, n)
        out = [(d, s, best, n) for (d, s), best, n in live.items()]
        if out:
            yield _columns(out)

    return dealt.sortWithinPartitions("step").mapInArrow(run, _INDEX_SCHEMA)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept, text_sha256: one row per input row.

    Of equal texts the row with the largest id stays.  Rows that repeat an id
    with the same text all carry that id, and all are marked kept if it is the
    largest; ``drop_copies`` keeps one of them.  A null id loses to any id.
    """
    spark = docs.sparkSession
    rows = write_and_read(digests(docs, id_col, text_col), "digests")
    groups = build_index(rows).where("copies > 1").select(
        F.col("digest").alias("_d"), F.col("size").alias("_s"), F.col("best").alias("_best"), F.col("copies").alias("_n"))
    # Only texts that occur more than once need their group's row; a frequent
    # digest is on one side only once, so Spark can split the other side.
    out = rows.join(groups, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")), "left")
    keep = F.when(F.col("_n").isNull(), F.col("id")).otherwise(F.col("_best"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"),
                      F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
                      F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return dedup(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest doc_id stays.

    Rows equal in doc_id and text are copies like any other: one stays.  The
    texts move once, dealt out by doc_id and digest, which serves both the join
    and the choice among repeated rows.
    """
    gone = dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"))
    return keep_texts(docs, lambda texts: _digest_column(texts)[0], gone, "left_anti")
