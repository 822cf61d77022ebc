"""Vector codes by parts, with memoised grid cells.

A vector becomes whole numbers, floor(256 x), and is cut into ``PARTS`` equal parts.
Each part position has a codebook of at most ``ENTRIES`` entries; the code of a
vector lists, part by part, the index of the nearest entry (squared Euclidean
distance, ties to the lower index).

Finding the nearest entry: a part falls into a cell of a coarse grid.  For a cell's
box, entry e lies at least ``near(e)`` and at most ``far(e)`` away from any point in
it; an entry whose ``near`` exceeds the smallest ``far`` is dominated across the box
and can be nearest to none of its points.  What is left is remembered by cell, so a
cell is worked out once a task and only its entries are evaluated, exactly, for every
part that falls into it.  The grid's step follows the codebook; any step gives the
same codes.  A task forgets its cells beyond ``CELLS_HELD``, which costs time alone.

Training: the codebooks start as the parts of the first ``ENTRIES`` vectors by id;
a round assigns every part and replaces each entry by the componentwise
floor(sum / count) of its parts.  Tasks return at most one row for each part position
and entry, so what reaches the driver is as large as the codebooks, whatever the table.

Defined cases.  Rows whose vector is null or holds a null or non-finite component are
dropped.  Shorter vectors count as if filled with zeros up to the longest one, whose
length is rounded up to a multiple of ``PARTS``.  Whole numbers beyond +-2**26
saturate, so that squared distances stay exact in 64 bits.  The first vectors are
ordered by id (nulls last), then by components; rows that repeat an id are separate
vectors.  Fewer than ``ENTRIES`` vectors make smaller codebooks; entries that no part
chose stay.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from shiftspark.llm.common import map_batches, read_table
from shiftspark.session import ship_package, write_and_read

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SATURATE = 1 << 26
#: The grid's step is so small a share of a codebook's width.
STEPS_ACROSS = 12
CELLS_HELD = 1 << 15
#: Parts looked up at once.
BLOCK = 1 << 14


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors kept: their places in the batch, where each begins, all components."""
    vectors = vectors if isinstance(vectors, pa.ListArray) else vectors.cast(pa.list_(vectors.type.value_type))
    edge = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    # Nulls arrive as NaN, so one test finds both.
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (bad[edge[1:]] == bad[edge[:-1]]) & ~vectors.is_null().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.clip(np.floor(np.where(np.isfinite(x), x, 0.0) * SCALE), -SATURATE, SATURATE).astype(np.int32)
    size = (edge[1:] - edge[:-1])[at]
    begin = np.concatenate([[0], np.cumsum(size)])
    held = np.concatenate([y[edge[i]:edge[i + 1]] for i in at]) if len(at) and len(at) < len(ok) else (
        y[edge[0]:edge[-1]] if len(at) else y[:0])
    return at, begin, held


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, v (whole numbers) of the rows that are kept."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, begin, held = whole_numbers(b.column("v"))
        if len(at):
            v = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(held, pa.int32()))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("label").take(take), v],
                                             names=["id", "label", "v"])

    return map_batches(rows, run, StructType([rows.schema["id"], rows.schema["label"],
                                              StructField("v", ArrayType(IntegerType()))]))


def padded(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` whole numbers, filled with zeros."""
    edge = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)
    size = edge[1:] - edge[:-1]
    if len(size) and (size == dim).all():
        return values[edge[0]:edge[-1]].reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values[edge[0]:edge[-1]]
    return out


@dataclass
class Grid:
    """One part position: its codebook and the cells met so far."""

    book: np.ndarray
    step: int = 1
    cells: dict[bytes, int] = field(default_factory=dict)
    kept: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of(book: np.ndarray) -> Grid:
        width = int(book.max() - book.min()) if book.size else 0
        return Grid(book, max(1, width // STEPS_ACROSS))

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell (its coordinates), the entries that may be nearest to a point in it."""
        low = (cells * self.step)[:, None, :]
        high = low + (self.step - 1)
        to_low, to_high = low - self.book[None], self.book[None] - high
        near = np.maximum(np.maximum(to_low, to_high), 0)
        far = np.maximum(np.abs(to_low), np.abs(to_high))
        near, far = (near * near).sum(axis=2), (far * far).sum(axis=2)
        keep = near <= far.min(axis=1)[:, None]
        return [np.flatnonzero(k) for k in keep]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every point's nearest entry."""
        cells, which = np.unique(points // self.step, axis=0, return_inverse=True)
        which = which.reshape(-1)
        if len(self.cells) + len(cells) > CELLS_HELD:
            self.cells.clear()
            self.kept.clear()
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.cells]
        if new:
            for i, entries in zip(new, self.undominated(cells[new]), strict=True):
                self.cells[keys[i]] = len(self.kept)
                self.kept.append(entries)
        lists = [self.kept[self.cells[k]] for k in keys]
        length = np.array([len(e) for e in lists])
        first = np.cumsum(length) - length
        flat = np.concatenate(lists)
        # A row for each point and entry of its cell; entries ascend, so the first least one wins ties.
        count = length[which]
        start = np.cumsum(count) - count
        entry = flat[np.repeat(first[which] - start, count) + np.arange(int(count.sum()))]
        diff = np.repeat(points, count, axis=0) - self.book[entry]
        dist = np.einsum("ij,ij->i", diff, diff)
        least = np.minimum.reduceat(dist, start)
        hit = np.flatnonzero(dist == np.repeat(least, count))
        owner = np.searchsorted(start, hit, side="right") - 1
        chosen = np.unique(owner, return_index=True)[1]
        return entry[hit[chosen]], least


def assigned(rows: np.ndarray, grids: list[Grid]) -> tuple[np.ndarray, np.ndarray]:
    """Entry index of every part (rows x PARTS) and the rows' total squared distance."""
    n, part = len(rows), rows.shape[1] // PARTS
    index, error = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
    for a in range(0, n, BLOCK):
        block = rows[a:a + BLOCK]
        for p, grid in enumerate(grids):
            i, d = grid.nearest(block[:, p * part:(p + 1) * part])
            index[a:a + BLOCK, p] = i
            error[a:a + BLOCK] += d
    return index, error


def first_books(vectors: DataFrame, dim: int) -> np.ndarray:
    """(PARTS, entries, part length): the parts of the first vectors by id."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    first = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        first[i, :len(r[0])] = r[0]
    return first.reshape(len(rows), PARTS, dim // PARTS).transpose(1, 0, 2).copy()


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    ship_package(vectors.sparkSession)
    entries, part = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid.of(b) for b in books]
        count = np.zeros((PARTS, entries), np.int64)
        total = np.zeros((PARTS, entries, part), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = padded(b.column(0), PARTS * part)
            index, _ = assigned(rows, grids)
            for p in range(PARTS):
                count[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(total[p], index[:, p], rows[:, p * part:(p + 1) * part])
        p, e = np.nonzero(count)
        if len(p):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * part, pa.int32()), pa.array(total[p, e].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums],
                                             names=["p", "e", "n", "total"])

    sums = vectors.select("v").mapInArrow(run, "p int, e int, n long, total array<long>")
    sums = sums.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(part)])
    new = books.copy()
    for r in sums.collect():        # at most PARTS x ENTRIES rows
        new[r[0], r[1]] = [t // r[2] for t in r[3:]]
    return new


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks of ``vectors`` (id, v); None if there are none."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    dim = max(1, -(-longest // PARTS)) * PARTS
    books = first_books(vectors, dim)
    for _ in range(rounds):
        books = refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of every vector."""
    schema = StructType([vectors.schema["id"], vectors.schema["label"]]).add("code", "string").add("error", "long")
    ship_package(vectors.sparkSession)
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid.of(b) for b in books]
        for b in batches:
            if not b.num_rows:
                continue
            index, error = assigned(padded(b.column("v"), PARTS * books.shape[2]), grids)
            code = ["".join(r) for r in hexes[index]]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code), pa.array(error)],
                                             names=["id", "label", "code", "error"])

    return vectors.select("id", "label", "v").mapInArrow(run, schema)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col``, code, error, label_error, codebooks_sha256 of every vector kept.

    ``label_error`` is the error summed over the rows of one label, nulls together;
    it saturates at the largest long.
    """
    vectors = write_and_read(kept_vectors(df, id_col, vec_col, label_col), "vectors")
    books = train(vectors)
    if books is None:
        books = np.zeros((PARTS, 0, 1), np.int64)
    codes = write_and_read(encode(vectors, books), "codes")
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    summed = write_and_read(codes.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error")), "label-errors")
    summed = summed.select(F.col("label").alias("_of"), "label_error")
    return codes.join(summed, F.col("label").eqNullSafe(F.col("_of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of ``embeddings``."""
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _round_sql(before: str, name: str) -> str:
    """Two CTEs: the parts assigned to the entries of ``before``, and the entries after the round."""
    # The quotient of whole numbers, rounded down also where the sum is negative.
    mean = ", ".join(f"CAST((sum(v[{j}]) - ((sum(v[{j}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for j in range(1, 5))
    return f""",
a_{name} AS (
  SELECT vec_id, rn, label, part, v, min(d * 256 + e) // 256 AS d, min(d * 256 + e) % 256 AS e FROM (
    SELECT p.vec_id, p.rn, p.label, p.part, p.v, b.e,
           CAST((p.v[1]-b.v[1])*(p.v[1]-b.v[1]) + (p.v[2]-b.v[2])*(p.v[2]-b.v[2])
              + (p.v[3]-b.v[3])*(p.v[3]-b.v[3]) + (p.v[4]-b.v[4])*(p.v[4]-b.v[4]) AS BIGINT) AS d
    FROM parts p JOIN {before} b ON p.part = b.part) GROUP BY vec_id, rn, label, part, v),
{name} AS (
  SELECT b.part, b.e, coalesce(s.v, b.v) AS v FROM {before} b LEFT JOIN (
    SELECT part, e, [{mean}] AS v FROM a_{name} GROUP BY part, e) s ON s.part = b.part AND s.e = b.e)"""


#: For vectors of 64 components, as the given table has them.
OP11_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) AS rn
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, rn, label, part, v[part * 4 + 1:part * 4 + 4] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, rn - 1 AS e, v FROM parts WHERE rn <= 64)""" + _round_sql("b0", "b1") + _round_sql("b1", "b2") + _round_sql("b2", "b3") + """,
codes AS (
  SELECT vec_id, rn, label, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a_b3 GROUP BY vec_id, rn, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(v[1] || ',' || v[2] || ',' || v[3] || ',' || v[4], ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM codes
"""
