"""Divergence audit of sources: which sources of a language write unlike each other, and in which terms.

Terms are maximal runs of A-Z, a-z and code points from 128 on, with A-Z
lower-cased.  They are read from the UTF-8 bytes, where that class is a class of
bytes, so nothing is decoded.  A language keeps the terms that occur in at least
``MIN_DOCS`` of its documents.

Finding them by iceberg prefix refinement: level after level, terms are looked at
through their first ``LEVELS`` bytes, longer ones each time.  A level counts for each
language and prefix the distinct documents that hold a term with it, and discards the
prefixes below the threshold: no term under one can be kept, so the next level counts
only what is left, and the last one counts complete terms, exactly.  The rare terms,
most of a vocabulary, thus never reach a shuffle.  A level goes over the texts once.
Tasks count in chunks and send one row for each prefix of a chunk.  The prefixes that
stay go to the next level as a bitmap of ``BITS`` bits (2 MB, whatever the table) over
their CRC-32: a collision lets a prefix pass that could have gone, never the other way
round, and the threshold on complete terms is exact.

Then, for every (lang, source) group and for the language, a kept term has the share
p = 1 + floor(10**9 (count + 5) / (N + 5 V)), with N all counts of kept terms there and V
the language's kept terms.  Everything is whole numbers (products as decimals).

* ``pair``: for each other source of the language, the sum of |p - q| over all kept terms.
  Terms are dealt by hash into blocks of about ``BLOCK_TERMS`` and sources into tiles of
  ``TILE``; a group is one block and two tiles, at most so large whatever the data.  Terms
  absent from a block's tiles count by number: each adds the same |p0 - q0|.
* ``term``: kept terms that the group has and with p above the language's, the 50 largest
  differences.

Defined cases: null text, lang and source are empty texts; every row is a document of
its own, also if rows repeat; a group without terms has N = 0; a language without kept
terms gives its pairs with value 0; ties rank by the item's UTF-8 bytes; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiftspark.llm.common import map_batches, read_table
from shiftspark.session import ship_package, write_and_read

MIN_DOCS = 30
SMOOTH = 5
TOP_TERMS = 50
UNIT = 1_000_000_000
#: Prefix lengths in bytes, level by level; complete terms follow.
LEVELS = (4, 10)
BITS = 1 << 24
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15
#: Text bytes counted at once, unless one text alone is longer.
CHUNK_BYTES = 16_000_000
BLOCK_TERMS = 2048
TILE = 256


def _byte_table() -> np.ndarray:
    """Lower-cased byte of a term, 0 for all others."""
    t = np.arange(256, dtype=np.uint8)
    t[:0x80] = 0
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


_BYTES = _byte_table()


def byte_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) row of consecutive groups of about ``CHUNK_BYTES``."""
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(edge, edge[start] + CHUNK_BYTES, side="right")) - 1
        end = min(len(texts), max(start + 1, end))
        yield start, end
        start = end


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms (binary), and for every occurrence in order its term's index and its text's."""
    n = len(texts)
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[edge[0]:edge[-1]] if held is not None else np.empty(0, np.uint8)
    edge = edge - edge[0]
    low = _BYTES[data]
    inside = np.zeros(len(low) + 2, bool)
    np.greater(low, 0, out=inside[1:-1])
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    # Terms end with their text: where letters meet over its end, one term ends and another begins.
    meet = edge[1:-1][inside[edge[1:-1]] & inside[edge[1:-1] + 1]]
    if len(meet):
        bounds = np.sort(np.concatenate([bounds, np.repeat(np.unique(meet), 2)]))
    begin, end = bounds[::2], bounds[1::2]
    at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(begin, edge)))
    found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(low[low > 0])]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc


def places(prefixes: list[bytes], lang: bytes) -> np.ndarray:
    """Bit of each prefix of a language."""
    seed = zlib.crc32(lang + b"\0")
    return np.fromiter((zlib.crc32(p, seed) for p in prefixes), np.int64, len(prefixes)) % BITS


def place_of(lang: Column, prefix: Column) -> Column:
    """The same as a column."""
    return F.crc32(F.concat(lang.cast("binary"), F.lit(bytearray(b"\0")), prefix)) % BITS


def live_terms(words: list[bytes], lang: bytes, length: int, bits: np.ndarray | None) -> np.ndarray:
    """Whether each term's prefix of ``length`` bytes stayed in the level before."""
    if bits is None:
        return np.ones(len(words), bool)
    at = places([w[:length] for w in words], lang)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.diff(np.append(at, len(keys)))


def _distinct(a: np.ndarray, b: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a, b), b < span."""
    pairs, _ = _counted(a * span + b)
    return pairs // span, pairs % span


def _renumbered(x: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``x`` (below ``span``) in order, and the place of each of ``x`` among them."""
    there = np.zeros(span, bool)
    there[x] = True
    used = np.flatnonzero(there)
    return used, (np.cumsum(there) - 1)[x]


def _languages(col: pa.Array) -> tuple[list[bytes], np.ndarray]:
    d = col.dictionary_encode()
    return [x.encode("utf-8", "surrogatepass") for x in d.dictionary.to_pylist()], d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def prefix_counts(docs: DataFrame, length: int, before: int, bits) -> DataFrame:
    """lang, prefix, docs of every prefix of ``length`` bytes whose own prefix of ``before`` bytes stayed.

    ``docs``: text, lang, source without nulls; ``bits``: broadcast bitmap of the level before, None at first.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column(0).cast(pa.binary())
        held = None if bits is None else bits.value
        for start, end in byte_chunks(texts):
            words, code, doc = terms(texts.slice(start, end - start))
            names, lang = _languages(b.column(1).slice(start, end - start))
            words = words.to_pylist()
            doc, code = _distinct(doc, code, max(1, len(words)))
            for g, name in enumerate(names):
                own = lang[doc] == g
                used, code_g = _renumbered(code[own], len(words))
                some = [words[w] for w in used]
                live = live_terms(some, name, before, held)
                prefix = pa.array([w[:length] for w in some], pa.binary()).dictionary_encode()
                of, prefixes = prefix.indices.to_numpy(zero_copy_only=False).astype(np.int64), prefix.dictionary.to_pylist()
                stay = live[code_g]
                _, p = _distinct(doc[own][stay], of[code_g][stay], max(1, len(prefixes)))
                n = np.bincount(p, minlength=len(prefixes))
                p = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.decode("utf-8", "surrogatepass")] * len(p), pa.string()), prefix.dictionary.take(pa.array(p)), pa.array(n[p], pa.int64())],
                    names=["lang", "prefix", "docs"])

    counts = map_batches(docs, run, "lang string, prefix binary, docs long")
    return counts.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))


def bitmap(places: DataFrame) -> np.ndarray:
    """``BITS`` bits, 8 a byte, with those in ``place`` set: at most BITS / BITMAP rows reach the driver."""
    rows = (places.groupBy(F.floor(F.col("place") / BITMAP).alias("part"))
            .agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits")).collect())
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        held = np.frombuffer(bytes(r[1]), np.uint8)
        out[r[0] * (BITMAP // 8):r[0] * (BITMAP // 8) + len(held)] = held
    return out


def refine(docs: DataFrame, min_docs: int, levels: tuple[int, ...]) -> tuple[int, object]:
    """The last level's length and its bitmap (broadcast) of the prefixes that stayed."""
    before, bits = 0, None
    for length in levels:
        stay = prefix_counts(docs, length, before, bits).where(F.col("docs") >= min_docs)
        before, bits = length, docs.sparkSession.sparkContext.broadcast(bitmap(stay.select(place_of(F.col("lang"), F.col("prefix")).alias("place"))))
    return before, bits


def term_counts(docs: DataFrame, before: int, bits) -> DataFrame:
    """lang, source, term (binary), docs, n of all complete terms whose prefix stayed."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column(0).cast(pa.binary())
        held = None if bits is None else bits.value
        for start, end in byte_chunks(texts):
            words, code, doc = terms(texts.slice(start, end - start))
            names, lang = _languages(b.column(1).slice(start, end - start))
            sources, source = _languages(b.column(2).slice(start, end - start))
            listed = words.to_pylist()
            span = max(1, len(listed))
            group = lang * len(sources) + source
            # Pairs of text and term, each once; then what a group has of them, and how often in all.
            pairs, times = _counted(doc * span + code)
            key = group[pairs // span] * span + pairs % span
            order = np.argsort(key, kind="stable")
            key, docs_n = _counted(key)
            n = np.add.reduceat(times[order], np.cumsum(docs_n) - docs_n) if len(key) else docs_n
            g, w = key // span, key % span
            live = np.zeros(len(key), bool)
            for i, name in enumerate(names):
                own = np.flatnonzero(g // len(sources) == i)
                used, at = _renumbered(w[own], span)
                live[own] = live_terms([listed[u] for u in used], name, before, held)[at]
            g, w = g[live], w[live]
            text = [pa.array([x.decode("utf-8", "surrogatepass") for x in names], pa.string()).take(pa.array(g // max(1, len(sources)))),
                    pa.array([x.decode("utf-8", "surrogatepass") for x in sources], pa.string()).take(pa.array(g % max(1, len(sources))))]
            yield pa.RecordBatch.from_arrays(
                [*text, words.take(pa.array(w)), pa.array(docs_n[live], pa.int64()), pa.array(n[live], pa.int64())],
                names=["lang", "source", "term", "docs", "n"])

    counts = map_batches(docs, run, "lang string, source string, term binary, docs long, n long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH kept)), exactly."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    below = total.cast("decimal(19,0)") + (F.lit(SMOOTH).cast("decimal(2,0)") * kept.cast("decimal(12,0)"))
    return (F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(19,0)"))) + 1).cast("long")


def _pair_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums over one block of terms for the sources of two tiles.

    Rows without a term give each source's share of an absent term, and in block 0 the
    number of all kept terms; the others are cells.
    """
    lang, block, ta, tb = (k.as_py() for k in key)
    idx, p = table.column("idx").to_numpy(), table.column("p").to_numpy()
    word = table.column("term")
    blank = word.is_null().to_numpy()
    order = np.flatnonzero(blank)
    order = order[np.argsort(idx[order], kind="stable")]
    sources, absent = idx[order], p[order]
    names = table.column("source").take(pa.array(order)).to_pylist()
    kept = int(table.column("kept").to_numpy()[order[0]]) if block == 0 else 0
    cell = np.flatnonzero(~blank)
    row = np.unique(word.take(pa.array(cell)).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), return_inverse=True)[1] if len(cell) else np.empty(0, int)
    n = int(row.max()) + 1 if len(row) else 0
    m = np.repeat(absent[None], n, axis=0)
    m[row, np.searchsorted(sources, idx[cell])] = p[cell]
    first = np.flatnonzero(sources // TILE == ta)
    second = np.flatnonzero(sources // TILE == tb)
    own, other, value = [], [], []
    for i in first:
        base = np.abs(absent[second] - absent[i])
        total = np.abs(m[:, second] - m[:, i:i + 1]).sum(axis=0) + (kept - n) * base
        ne = second != i
        own += [names[i]] * int(ne.sum())
        other += [names[j] for j in second[ne]]
        value += total[ne].tolist()
    if ta != tb:        # both directions; within a tile the loop has met both
        own, other, value = own + other, other + own, value + value
    return pa.table({"lang": pa.array([lang] * len(own), pa.string()), "source": pa.array(own, pa.string()),
                     "item": pa.array(other, pa.string()), "value": pa.array(value, pa.int64())})


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for all pairs of sources of one language.

    ``cells``: lang, source, term, p; ``groups``: lang, source, p0 and kept (the language's kept terms).
    """
    ship_package(cells.sparkSession)
    order = Window.partitionBy("lang")
    groups = groups.withColumn("idx", F.row_number().over(order.orderBy("source")) - 1).withColumns({
        "tiles": F.ceil(F.count("*").over(order) / TILE).cast("int"),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK_TERMS)).cast("int")})
    groups = write_and_read(groups, "source-groups")
    at = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "idx", "tiles", "blocks")
    from_cells = cells.join(at, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).select(
        "lang", F.lit(None).cast("string").alias("source"), "term", "p", "idx", "tiles", F.lit(0).cast("long").alias("kept"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    from_groups = groups.select("lang", "source", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"), "idx", "tiles", "kept",
                                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tile = F.floor(F.col("idx") / TILE).cast("int")
    rows = from_cells.unionByName(from_groups).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "block", F.least(tile, "other").alias("ta"), F.greatest(tile, "other").alias("tb"),
        "source", "term", "p", "idx", "kept")
    sums = rows.groupBy("lang", "block", "ta", "tb").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, levels: tuple[int, ...] = LEVELS, top: int = TOP_TERMS,
               text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counted = write_and_read(term_counts(docs, *refine(docs, min_docs, levels)), "term-counts")
    kept = write_and_read(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
                          .where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    cells = counted.join(kept, ["lang", "term"])
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    zero = F.lit(0).cast("long")
    groups = (docs.select("lang", "source").distinct()
              .join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(per_lang, "lang", "left")
              .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"),
                      F.coalesce("total_lang", zero).alias("total_lang")))
    # A language without kept terms: no share of an absent term either, 0 for all.
    groups = write_and_read(groups.withColumn("p0", F.coalesce(share(zero, F.col("total"), F.col("kept")), zero)), "groups")
    of = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "total", "kept", "total_lang")
    shares = write_and_read(
        cells.join(of, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
        .select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q")), "shares")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (source_pairs(shares.select("lang", "source", "term", "p"), groups.select("lang", "source", "p0", "kept"))
             .withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair")))
    above = (shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return pairs.unionByName(above).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all ``documents``."""
    return divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (
  SELECT id, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM docs)),
kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cells AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k USING (lang, term) GROUP BY f.lang, f.source, f.term),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source) t USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {SMOOTH}) // CAST(g.total + {SMOOTH} * v.v AS HUGEINT) AS p,
         1 + CAST({UNIT} AS HUGEINT) * (k.n + {SMOOTH}) // CAST(v.total + {SMOOTH} * v.v AS HUGEINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(CAST(s.value AS BIGINT), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
             GROUP BY x.lang, x.source, y.source) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR r <= {TOP_TERMS}
"""
