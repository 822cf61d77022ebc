"""Repeated passages by sparse suffix arrays.

A passage is repeated if ``MIN_WORDS`` words in a row also occur in a document
with another id.  Sorting all suffixes of a corpus would find them; here only
the suffixes at content-selected positions are kept:

1. The anchor of 50 words in a row is the smallest hash among their 8-word runs
   (the minimiser).  Equal passages have the same anchor at the same place, and
   about one word in 22 is an anchor.
2. The suffixes at anchors are sorted by their first 8 words and neighbours are
   compared: anchors without an equal neighbour in another text go.
3. Around each anchor that is left, the match is extended to the left and to the
   right: the runs of 50 words whose anchor it is, from the first to the last
   one, are sorted with those of all other anchors, and neighbours compared.
   A run that has an equal one in another text is repeated; no repeated run
   is missed, since equal runs have equal anchors.
4. Overlapping and touching repeated runs of a text are one span.

Sorting is by range over (hash, text), so the rows of a passage that a third of
all documents share are spread over many tasks; what a task sees cut off at its
ends is settled in a small second step.

Texts that are equal to the letter are sorted as one; if their ids differ, the
whole text, if it has 50 words, is a span of each.  Words are runs of letters and
digits, compared without case.  Null and shorter texts have no spans.  Rows that
repeat id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiftspark.llm import text as T
from shiftspark.llm.common import NO_ID, map_batches, read_table
from shiftspark.session import ship_package, write_and_read

MIN_WORDS = 50
ANCHOR_WORDS = 8


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` values in a row, the first of equals.

    The lower bits give way to the place, so values are compared by the others.
    """
    n = len(x) - width + 1
    bits = np.uint64(max(1, int(len(x)).bit_length()))
    full = -(-len(x) // width) * width
    key = np.full(full, ~np.uint64(0), np.uint64)
    key[:len(x)] = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of every run of MIN_WORDS words: anchor hash, run hash, text, first word (in
    the text), begin and end offset."""
    h, doc, begin, end = T.words(texts)
    run, at = T.windows(h, doc, MIN_WORDS)
    if not len(at):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), run, none, none, none, none
    power = np.zeros(len(h) - ANCHOR_WORDS + 1, np.uint64)
    for j in range(ANCHOR_WORDS):
        power = power * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - ANCHOR_WORDS + 1 + j]
    gram = T.mix64(power)
    anchor = gram[sliding_argmin(gram, MIN_WORDS - ANCHOR_WORDS + 1)[at]]
    owner = doc[at]
    first = np.searchsorted(doc, np.arange(len(texts)))
    return anchor, run, owner, at - first[owner], begin[at], end[at + MIN_WORDS - 1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.md5(text).alias("digest"), text.alias("text"))


def _anchors(rows: DataFrame) -> DataFrame:
    """id, digest, words, begin, end (of the first and last word), distinct anchors."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in T.chunks(b.column("text").to_pylist()):
            anchor, _, owner, _, _, _ = runs(part)
            _, doc, begin, end = T.words(part)
            count = np.bincount(doc, minlength=len(part))
            last = np.cumsum(count)
            edge = np.searchsorted(owner, np.arange(len(part) + 1))
            pick = lambda a, i: np.where(count > 0, a[np.clip(i, 0, max(0, len(a) - 1))], 0) if len(a) else np.zeros(len(part), int)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(start, len(part)) for c in ("id", "digest")), pa.array(count.astype(np.int32)),
                 pa.array(pick(begin, last - count).astype(np.int32)), pa.array(pick(end, last - 1).astype(np.int32)),
                 pa.array([np.unique(anchor[a:z]).view(np.int64) for a, z in zip(edge, edge[1:], strict=False)], pa.list_(pa.int64()))],
                names=["id", "digest", "words", "begin", "end", "anchors"])

    return map_batches(rows, run, "id long, digest string, words int, begin int, end int, anchors array<long>")


_SORTED = "key long, uid long, first int, begin int, end int"
_NAMES = ["key", "uid", "first", "begin", "end"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and uid: which have an equal key with another uid.

    state 1: yes.  The first and the last key of a task may go on in another one:
    their extreme uids are told (state 2), and their rows, while only one uid has
    been seen, are passed on undecided (state 0).
    """
    held: list[np.ndarray] = [np.empty((5, 0), np.int64)]     # rows of the last key, while it has one uid
    key, low, high, first_key = None, 0, 0, None

    def out(cols: np.ndarray, state: int) -> pa.RecordBatch:
        arrays = [pa.array(cols[0]), pa.array(cols[1]), *(pa.array(c.astype(np.int32)) for c in cols[2:]),
                  pa.array(np.full(cols.shape[1], state, np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "state"])

    def told(k: int, a: int, z: int) -> pa.RecordBatch:
        return out(np.array([[k, k], [a, z], [0, 0], [0, 0], [0, 0]], np.int64), 2)

    for b in batches:
        rows = np.stack([b.column(c).to_numpy().astype(np.int64) for c in _NAMES])
        edge = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        stop = np.append(edge[1:], rows.shape[1])
        i = 0
        if key is not None and rows[0, 0] == key:              # the last key goes on
            a, z = edge[0], stop[0]
            high = rows[1, z - 1]
            if low != high:
                if held:
                    yield out(np.concatenate([*held, rows[:, a:z]], 1), 1)
                    held = []
                else:
                    yield out(rows[:, a:z], 1)
            else:
                held.append(rows[:, a:z])
            i = 1
        if i < len(edge):                                      # the last key has ended
            if key is not None and key == first_key:
                yield told(key, low, high)
                if held:
                    yield out(np.concatenate(held, 1), 0)
            if first_key is None:
                first_key = int(rows[0, 0])
            mixed = rows[1, edge] != rows[1, stop - 1]
            if i < len(edge) - 1:
                inner = np.zeros(rows.shape[1], bool)
                whole = np.repeat(mixed[i:-1], stop[i:-1] - edge[i:-1])
                inner[edge[i]:stop[-2]] = whole
                if inner.any():
                    yield out(rows[:, inner], 1)
                if i == 0 and int(rows[0, 0]) == first_key:    # the task's first key ends here
                    yield told(first_key, int(rows[1, 0]), int(rows[1, stop[0] - 1]))
                    if not mixed[0]:
                        yield out(rows[:, :stop[0]], 0)
            a, z = edge[-1], stop[-1]
            key, low, high = int(rows[0, a]), int(rows[1, a]), int(rows[1, z - 1])
            held = []
            if low != high:
                yield out(rows[:, a:z], 1)
            else:
                held = [rows[:, a:z]]
    if key is not None:
        yield told(key, low, high)
        if held:
            yield out(np.concatenate(held, 1), 0)


def with_equal_neighbour(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (key, uid, first, begin, end) those whose key occurs with another uid."""
    ship_package(rows.sparkSession)
    ordered = rows.repartitionByRange("key", "uid", "first").sortWithinPartitions("key", "uid", "first")
    seen = write_and_read(ordered.mapInArrow(_neighbours, _SORTED + ", state int"), "neighbours")
    ends = seen.where("state = 2").groupBy("key").agg(F.min("uid").alias("a"), F.max("uid").alias("z")).where("a <> z").select("key")
    late = seen.where("state = 0").join(ends, "key", "left_semi")
    return seen.where("state = 1").unionByName(late).select(*_NAMES)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, first_word, end_word, begin, end (character offsets) of every repeated passage."""
    rows = _keyed(docs, id_col, text_col)
    seen = write_and_read(_anchors(rows).withColumn("uid", F.monotonically_increasing_id()), "anchors")
    texts = write_and_read(
        seen.groupBy("digest").agg(F.min("uid").alias("rep"), F.min("id").alias("low"), F.max("id").alias("high")), "texts")
    reps = seen.join(texts.select(F.col("rep").alias("uid")), "uid", "left_semi")

    zero = F.lit(0)
    anchors = reps.select(F.explode("anchors").alias("key"), "uid", zero.alias("first"), zero.alias("begin"), zero.alias("end"))
    shared = with_equal_neighbour(anchors).groupBy("uid").agg(F.collect_set("key").alias("shared"))
    # The texts move once, to meet the anchors they share with others.
    chosen = reps.select("uid", "id", "digest").join(shared, "uid")

    def extend(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uid, keys = b.column("uid").to_numpy(), b.column("shared").to_pylist()
        for start, part in T.chunks(b.column("text").to_pylist()):
            anchor, run, owner, first, begin, end = runs(part)
            edge = np.searchsorted(owner, np.arange(len(part) + 1))
            keep = np.zeros(len(run), bool)
            for i, (a, z) in enumerate(zip(edge, edge[1:], strict=False)):
                keep[a:z] = np.isin(anchor[a:z].view(np.int64), np.array(keys[start + i], np.int64))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(run[at].view(np.int64)), pa.array(uid[start + owner[at]]),
                 *(pa.array(x[at].astype(np.int32)) for x in (first, begin, end))], names=_NAMES)

    met = rows.join(chosen, ["id", "digest"]).select("uid", "shared", "text")
    found = with_equal_neighbour(write_and_read(map_batches(met, extend, _SORTED), "runs"))

    line = Window.partitionBy("uid").orderBy("first")
    gap = F.col("first") > F.lag("first").over(line) + MIN_WORDS
    spans = (found.distinct().withColumn("new", F.when(gap, 1).otherwise(0)).withColumn("span", F.sum("new").over(line))
             .groupBy("uid", "span").agg(F.min("first").alias("first_word"), (F.max("first") + MIN_WORDS).alias("end_word"),
                                         F.min("begin").alias("begin"), F.max("end").alias("end")))
    where = ["first_word", "end_word", "begin", "end"]
    known = seen.join(texts, "digest").select("id", "words", "begin", "end", "rep", (F.col("low") != F.col("high")).alias("copied")).distinct()
    whole = known.where(F.col("copied") & (F.col("words") >= MIN_WORDS)).select(
        "id", F.lit(0).alias("first_word"), F.col("words").alias("end_word"), "begin", "end")
    part = known.where(~F.col("copied")).select("id", F.col("rep").alias("uid")).join(spans, "uid").select("id", *where)
    out = whole.unionByName(part).distinct()
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), *where)


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the repeated passages of every document that has one."""
    return repeated_spans(read_table(spark, sf_dir, "documents"))
