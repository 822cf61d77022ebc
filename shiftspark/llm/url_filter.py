"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule allows or blocks are the accepted and rejected training urls.
For each class, character n-grams of orders 0 to ``ORDER`` are counted over all
of them; a smoothed variable-order Markov model mixes the orders (Witten-Bell:
a context hands the mass of its distinct followers down to the shorter one, and
a context never seen hands down all).  A url's score is the log-likelihood of the
accepted model minus that of the rejected one, divided by its length.

Counts are exact and stay a Spark table that grows with the corpus: an n-gram (its
context and symbol, ``ORDER + 1`` bytes) is a 64-bit number, and shorter ones are its
low bytes, so their counts are sums over it.  The table also lists the n-grams of
urls without a rule, with count 0, and gets the probability of each under each
model, order by order.  Urls then meet it by ``CHUNK`` of them: one row for each
distinct n-gram of a chunk.  Spark sizes these rows by the urls' file, a small part of
them, so the joins say how they are done: tables of n-grams are merged, and only
those of at most ``2**(8 * SENT)`` rows are broadcast.  The threshold is calibrated out of sample: urls are
split in two by a hash of the url, each half is scored by the model of the other,
and the threshold with the best mean of both classes' accuracies is taken, from a
histogram of ``BINS`` bins.

With no accepted or no rejected url the two models can't be compared, and urls
without a rule get the verdict of the class that there is, or allow.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end; a null url or one without ``://`` has an
empty host and path, and its characters, if any, still count for the models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiftspark.llm.common import map_batches, read_table
from shiftspark.session import ship_package, write_and_read

ORDER = 5
BINS = 2000
#: Urls that look up their n-grams together; divides the 2**33 row numbers of a partition.
CHUNK = 256
#: N-grams of so many bytes, a row each at most, are broadcast.
SENT = 2
#: Scores are clipped to this many nats a character for the histogram.
WIDEST = 8.0
ALPHABET = 256

#: host/path -> verdict; the rules of the registered query.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host(url: Column) -> Column:
    h = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(h, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; null if none does.  Of equally long rules at
    most one can fit a url, so their order doesn't matter."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, slash, p = rule.partition("/")
        h = h.lower()
        fits = ((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(slash + p))
        out = F.when(fits, rule).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for r, v in rules.items():
        out = F.when(rule == r, v).otherwise(out)
    return out


def _contexts(urls: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of every character and end of the urls: symbol, context of each order (its
    bytes, the nearest lowest), url."""
    data = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    flat = np.frombuffer(b"".join(b"\x01" * ORDER + d + b"\x02" for d in data), np.uint8).astype(np.int64)
    size = np.fromiter((len(d) + ORDER + 1 for d in data), np.int64, len(data))
    owner = np.repeat(np.arange(len(data)), size)
    begin = np.cumsum(size) - size
    at = np.flatnonzero(np.arange(len(flat)) - begin[owner] >= ORDER)
    contexts = [np.zeros(len(at), np.int64)]
    for n in range(1, ORDER + 1):
        contexts.append(contexts[-1] | flat[at - n] << 8 * (n - 1))
    return flat[at], contexts, owner[at]


def _cells(symbol: np.ndarray, contexts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the keys of the context and of context and symbol."""
    return [(c, c << 8 | symbol) for c in contexts]


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram that ends at every character and end of the urls, and its url."""
    symbol, contexts, owner = _contexts(urls)
    return _cells(symbol, contexts)[ORDER][1], owner


#: Halves (2: both) and classes of the models.
_MODELS = [(half, kept) for half in (0, 1, 2) for kept in (0, 1)]
_COUNTED = ["n00", "n01", "n10", "n11"]


def _seen(half: int, kept: int) -> Column:
    return F.col(f"n{half}{kept}") if half < 2 else F.col(f"n0{kept}") + F.col(f"n1{kept}")


def ngram_counts(rows: DataFrame) -> DataFrame:
    """gram and its counts by half and class (n00 ... n11) over all ``rows`` (url,
    half, kept 0 or 1); n-grams of rows with null kept are listed and not counted.

    Each batch adds up its own n-grams first.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = b.column("kept").fill_null(-1).to_numpy()
        group = np.where(kept < 0, 4, b.column("half").to_numpy() * 2 + kept)
        gram, owner = _grams(b.column("url").to_pylist())
        value, at = np.unique(gram, return_inverse=True)
        n = np.bincount(at * 5 + group[owner], minlength=5 * len(value)).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(value), *(pa.array(n[:, j].copy()) for j in range(4))], names=["gram", *_COUNTED])

    got = map_batches(rows.select("url", "half", "kept"), run, "gram long, " + ", ".join(f"{c} long" for c in _COUNTED))
    return got.groupBy("gram").agg(*(F.sum(c).alias(c) for c in _COUNTED))


def probabilities(counts: DataFrame) -> DataFrame:
    """gram and its probability under each model (p00 ... p21) for all n-grams of ``counts``.

    A context has at most one row for each byte that follows it, and so has an
    n-gram for each byte before it: no key of these joins is hot.
    """
    levels = [write_and_read(counts, "url-ngrams")]
    for n in reversed(range(ORDER)):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * (n + 1)) - 1).cast("long"))
        levels.append(write_and_read(levels[-1].groupBy(low.alias("gram")).agg(*(F.sum(c).alias(c) for c in _COUNTED)), "url-ngrams"))
    out = None
    for n, level in enumerate(reversed(levels)):
        # Order 0 has one context, the empty one, and one row a byte.
        same = Window.partitionBy(F.shiftright("gram", 8))
        told = level.select("gram", *(c for h, k in _MODELS for c in (
            _seen(h, k).alias(f"s{h}{k}"), F.sum(_seen(h, k)).over(same).alias(f"t{h}{k}"),
            F.sum((_seen(h, k) > 0).cast("long")).over(same).alias(f"k{h}{k}"))))
        if out is None:
            below = {m: F.lit(1.0 / ALPHABET) for m in _MODELS}
        else:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))
            lower = out.select(F.col("gram").alias("shorter"), *(F.col(f"p{h}{k}").alias(f"q{h}{k}") for h, k in _MODELS))
            told = told.withColumn("shorter", shorter).join(lower.hint("broadcast" if n <= SENT else "merge"), "shorter")
            below = {(h, k): F.col(f"q{h}{k}") for h, k in _MODELS}
        out = write_and_read(told.select("gram", *(
            F.when(F.col(f"t{h}{k}") > 0, (F.col(f"s{h}{k}") + F.col(f"k{h}{k}") * below[h, k]) / (F.col(f"t{h}{k}") + F.col(f"k{h}{k}")))
            .otherwise(below[h, k]).alias(f"p{h}{k}") for h, k in _MODELS)), "url-probabilities")
    return out


@dataclass
class CharModel:
    """The model of one half (2: both) and class over the n-gram table ``counts``."""
    counts: DataFrame
    half: int
    kept: int

    def logs(self, cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log probabilities of a few n-grams, seen or not."""
        gram = cells[ORDER][1]
        spark = self.counts.sparkSession
        asked = spark.createDataFrame([(int(g),) for g in np.unique(gram)], "gram long")
        listed = (self.counts.unionByName(asked.select("gram", *(F.lit(0).cast("long").alias(c) for c in _COUNTED)))
                  .groupBy("gram").agg(*(F.sum(c).alias(c) for c in _COUNTED)))
        p = dict(map(tuple, probabilities(listed).join(asked, "gram", "left_semi").select("gram", f"p{self.half}{self.kept}").collect()))
        return np.log([p[g] for g in gram.tolist()])


def _models(counts: DataFrame) -> dict[tuple[int, int], CharModel]:
    """The model of each half (2: both) and class."""
    return {(h, k): CharModel(counts, h, k) for h, k in _MODELS}


def _scored(rows: DataFrame, *carry: str) -> DataFrame:
    """``rows`` (url, half, kept) with score, by the models of both halves, and cross,
    by those of the other half: means over a url's characters of the log-likelihood
    difference."""
    spark = rows.sparkSession
    ship_package(spark)
    rows = write_and_read(rows.select("url", "half", "kept", *carry).withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1)), "url-rows")
    p = probabilities(ngram_counts(rows))
    ratio = p.select("gram", *((F.log(f"p{h}1") - F.log(f"p{h}0")).alias(f"d{h}") for h in (0, 1, 2)))

    def grams(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chunk = b.column("chunk").to_numpy()
        edge = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1, append=chunk[-1] + 1))
        for i, j in zip(edge, edge[1:], strict=False):
            value = np.unique(_grams(b.column("url").slice(i, j - i).to_pylist())[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), chunk[i])), pa.array(value)], names=["chunk", "gram"])

    def score(own: pa.Table, table: pa.Table) -> pa.Table:
        urls = own.column("url").to_pylist()
        gram, owner = _grams(urls)
        known = table.column("gram").to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known, gram, sorter=order)]
        n = np.bincount(owner, minlength=len(urls))
        by = [np.bincount(owner, table.column(f"d{h}").to_numpy()[at], len(urls)) / n for h in (0, 1, 2)]
        half = own.column("half").to_numpy()
        return own.select(["kept", *carry]).append_column("cross", pa.array(np.where(half == 0, by[1], by[0]))).append_column("score", pa.array(by[2]))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("kept", *carry)) + ", cross double, score double"
    looked = map_batches(rows.select("chunk", "url"), grams, "chunk long, gram long").join(ratio.hint("merge"), "gram")
    return write_and_read(rows.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(score, schema), "url-scores")


def threshold(scored: DataFrame) -> float:
    """The cut of ``cross`` with the best mean of both classes' accuracies."""
    half = BINS / 2
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("cross") / WIDEST * half + half))).cast("int")
    hist = np.zeros((2, BINS))
    for r in scored.where("kept IS NOT NULL").groupBy("kept", bin_.alias("bin")).count().collect():
        hist[r["kept"], r["bin"]] += r["count"]
    share = hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    # Threshold at each bin's lower edge: accepted from it on, rejected below it.
    right = share[1][::-1].cumsum()[::-1] + np.concatenate([[0], share[0].cumsum()[:-1]])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    cut = int(best[len(best) // 2])
    return (cut - half) / half * WIDEST


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict, score of every row."""
    url = F.col(url_col)
    rows = (pages.select(F.col(id_col).alias("id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"))
            .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
            .withColumn("by_rule", verdict_of(F.col("rule"), rules)))
    rows = (rows.withColumn("kept", (F.col("by_rule") == "allow").cast("int"))
            .withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")))
    there = {r[0] for r in rows.where("kept IS NOT NULL").select("kept").distinct().collect()}
    if there != {0, 1}:
        scored, rest = rows.withColumn("score", F.lit(0.0)), F.lit("block" if there == {0} else "allow")
    else:
        scored = _scored(rows, "id", "host", "path", "rule", "by_rule")
        rest = F.when(F.col("score") >= threshold(scored), "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("by_rule", rest).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return judge(read_table(spark, sf_dir, "pages"), RULES)
