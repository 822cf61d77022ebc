"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents long, so their plain similarity is near zero
even where a document holds a whole item.  Both sides are therefore partitioned
by size: items by the power of two above their number of distinct shingles, and
each document, for each such size ``u``, into overlapping segments of ``2u``
shingles in steps of ``u``.  Any passage of up to ``u`` shingles lies wholly in one
segment, and an item of which 0.8 are there has a Jaccard similarity of at least
0.19 with it (0.8q / (q + 2u - 0.8q) with q > u/2).  Item and segment then
agree in at least one of ``BANDS`` = 40 MinHash values but for 1 case in 4,500 at
that worst corner, and 1 in 10^8 where a whole item of size u is there.

The items' values are an index; documents look theirs up as they are read and
are never shuffled.  A hit is verified on whole sets: the item's shingles
found anywhere in the document, divided by the item's shingles, at least 0.8.

The index goes to every task, in blocks of at most about ``BLOCK_SHINGLES``
item shingles (some tens of MB): as many passes over the documents as blocks.

Items under five words have one shingle, all their words, which a document has
only if those are its words too.  Items and documents without words match none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shiftspark.llm import text as T
from shiftspark.llm.common import map_batches, read_table

CONTAINMENT = 0.8
BANDS = 40
BLOCK_SHINGLES = 1_000_000
_SIEVE_BITS = 20

_SEED = T.mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = T.mix64(_SEED) | np.uint64(1)


@dataclass
class ItemIndex:
    """MinHash values of the items by size class and band, and the items' shingle sets."""
    ids: list
    sets: list[np.ndarray]
    classes: list[int]                       # exponents of the size classes, ascending
    keys: np.ndarray                         # sorted
    owner: np.ndarray                        # item of each key
    sieve: np.ndarray                        # may a key be there, by its last bits

    @classmethod
    def build(cls, items: list[tuple]) -> "ItemIndex":
        ids, sets, keys, owner, found = [], [], [], [], set()
        for start, part in T.chunks([t for _, t in items]):
            s, o = T.shingles(part)
            for i in np.unique(o):
                own = np.unique(s[o == i])
                k = _size_class(len(own))
                found.add(k)
                keys.append(_key(np.array([_hash(own, b).min() for b in range(BANDS)]), k, np.arange(BANDS)))
                owner.append(np.full(BANDS, len(ids)))
                ids.append(items[start + i][0])
                sets.append(own)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        own = np.concatenate(owner) if owner else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[(key & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)] = True
        return cls(ids, sets, sorted(found), key[order], own[order], sieve)

    def candidates(self, s: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs that share a MinHash value, as rows."""
        if not len(s) or not self.classes:
            return np.empty((0, 2), np.int64)
        base = self.classes[0]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        at = np.flatnonzero(rank % (1 << base) == 0)             # begins of the smallest blocks
        texts, block = owner[at], rank[at] >> base
        out = []
        for b in range(BANDS):
            low, text, no = np.minimum.reduceat(_hash(s, b), at), texts, block
            for k in range(base, self.classes[-1] + 1):
                if k > base:                                     # blocks of twice the size
                    head = np.flatnonzero((no & 1) == 0)
                    low, text, no = np.minimum.reduceat(low, head), text[head], no[head] >> 1
                if k in self.classes:
                    two = low.copy()                             # a block and the next one
                    same = text[1:] == text[:-1]
                    two[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
                    key = _key(two, k, b)
                    may = np.flatnonzero(self.sieve[(key & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)])
                    lo, hi = (np.searchsorted(self.keys, key[may], side) for side in ("left", "right"))
                    for i in np.flatnonzero(hi > lo):
                        out.append(np.stack([np.full(hi[i] - lo[i], text[may[i]]), self.owner[lo[i]:hi[i]]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)

    def hits(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text, item, containment) of every verified pair, by text and item."""
        s, owner = T.shingles(texts)
        found, held, of = [], None, -1
        for t, i in self.candidates(s, owner):
            if t != of:
                held, of = np.unique(s[owner == t]), t
            own = self.sets[i]
            n = int(np.isin(own, held, assume_unique=True).sum())
            if n >= CONTAINMENT * len(own):
                found.append((int(t), int(i), n / len(own)))
        return found


def _size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _hash(s: np.ndarray, band: int) -> np.ndarray:
    return (s ^ _SEED[band]) * _ODD[band]


def _key(low: np.ndarray, size_class: int, band) -> np.ndarray:
    tag = np.atleast_1d(np.asarray(band, np.uint64)) * np.uint64(64) + np.uint64(size_class)
    return T.mix64(low ^ T.mix64(tag + np.uint64(1)))


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemIndex]:
    """Indexes of all items, block after block; an item's block is its hash's."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (6 * BLOCK_SHINGLES)) or 1                   # a word has six characters or so
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield ItemIndex.build(sorted(((r["id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r)))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, ``item_id``, containment of every document that holds an item.

    A document is a row: rows that repeat an id are judged apart, each by its own text.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"id {kinds[0]}, item {kinds[1]}, containment double"
    item_type = to_arrow_type(items.schema[item_id].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out: DataFrame | None = None
    for index in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(b: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            ix, ids = shared.value, b.column(0)
            for start, part in T.chunks(b.column(1).to_pylist()):
                if found := ix.hits(part):
                    t, i, c = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([start + x for x in t])),
                         pa.array([ix.ids[x] for x in i]).cast(item_type), pa.array(c, pa.float64())],
                        names=["id", "item", "containment"])

        part = map_batches(rows, run, schema)
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "containment")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, containment: every document of ``documents`` that holds an item of ``benchmark``."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH t AS (
  SELECT 'doc' AS kind, doc_id AS k, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
words_at AS (SELECT kind, k, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0),
shingle AS (SELECT DISTINCT kind, k, array_to_string(w[i:i + 4], ' ') AS s FROM words_at),
item AS (SELECT k, s, count(*) OVER (PARTITION BY k) AS n FROM shingle WHERE kind = 'item')
SELECT d.k AS doc_id, i.k AS item_id, count(*) / CAST(any_value(i.n) AS DOUBLE) AS containment
FROM shingle d JOIN item i ON d.s = i.s WHERE d.kind = 'doc'
GROUP BY d.k, i.k HAVING count(*) >= 0.8 * any_value(i.n)
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go.  Nothing is shuffled."""
    out = docs
    for index in _blocks(read_table(spark, sf_dir, "benchmark"), "item_id", "text"):
        shared = spark.sparkContext.broadcast(index)

        def run(b: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            keep = np.ones(b.num_rows, bool)
            for start, part in T.chunks(b.column("text").to_pylist()):
                keep[[start + t for t, _, _ in shared.value.hits(part)]] = False
            yield b.filter(pa.array(keep))

        out = map_batches(out, run, out.schema)
    return out
