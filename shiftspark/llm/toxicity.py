"""Toxicity: factorization machine over hashed terms.

A text is the set of its terms: its words and its words' first four letters,
hashed into ``2**hash_bits`` buckets.  With x the presence of the terms kept by
training, the logit is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

so a pair of terms (an insult and the mention of a group) can weigh more, or
less, than both alone, which additive weights cannot express.

Training uses a bounded sample of labelled rows (``per_class`` of each label in
expectation, chosen by a seeded hash; documented limits of the fit), weighted
back to the frequencies of all labelled rows.  Scoring reads every whole text.
Texts that are null, empty or without a known term get the base rate's score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm import text as T
from shiftspark.llm.common import lists_of, map_batches, read_table, sample_rows

PREFIX = 4


@dataclass(frozen=True)
class FMParams:
    hash_bits: int = 20
    factors: int = 8
    per_class: int = 3000
    min_docs: int = 3
    min_chi2: float = 10.8      # one in a thousand by chance
    max_terms: int = 8192
    epochs: int = 40
    rate: float = 0.15
    l2: float = 2e-4
    seed: int = 17


@dataclass
class FactorizationMachine:
    hash_bits: int
    terms: np.ndarray                    # kept buckets, ascending
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    index: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def logits(self, texts: list[str]) -> np.ndarray:
        if self.index is None:
            self.index = np.full(1 << self.hash_bits, -1, np.int32)
            self.index[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        bucket, doc = term_buckets(texts, self.hash_bits)
        i = self.index[bucket]
        known = i >= 0
        k = max(1, len(self.terms))
        pair = np.unique(doc[known].astype(np.int64) * k + i[known])
        return fm_logits(self.bias, self.weight, self.factor, pair // k, pair % k, len(texts))


def term_buckets(texts: list[str], hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms of the texts, and the index of the text of each."""
    h, doc, _, _, p = T.words(texts, PREFIX)
    shift = np.uint64(64 - hash_bits)
    return np.concatenate([h >> shift, p >> shift]).astype(np.int64), np.concatenate([doc, doc])


def fm_logits(b: float, w: np.ndarray, v: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, b) + np.bincount(doc, w[term], n)
    for f in range(v.shape[1]):
        x = v[term, f]
        out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _choose_terms(rows: list[np.ndarray], y: np.ndarray, p: FMParams) -> np.ndarray:
    """Buckets whose presence goes with the label (chi squared), the strongest first."""
    size = 1 << p.hash_bits
    all_docs, pos_docs = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r, label in zip(rows, y, strict=True):
        all_docs[r] += 1
        if label:
            pos_docs[r] += 1
    n, n1 = len(y), int(y.sum())
    a, b = pos_docs.astype(float), (all_docs - pos_docs).astype(float)
    c, d = n1 - a, n - n1 - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (a * d - b * c) ** 2 / (n1 * (n - n1) * all_docs * (n - all_docs))
    chi2 = np.where(np.isfinite(chi2) & (all_docs >= p.min_docs), chi2, 0)
    found = np.flatnonzero(chi2 >= p.min_chi2)
    return np.sort(found[np.lexsort((found, -chi2[found]))][:p.max_terms])


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, p: FMParams) -> FactorizationMachine:
    """AdaGrad on the weighted logistic loss; the same sample gives the same model."""
    rng = np.random.default_rng(p.seed)
    base = float(np.average(y, weights=weight)) if len(y) else 0.0
    base = min(max(base, 1e-3), 1 - 1e-3)
    terms = _choose_terms(rows, y, p) if 0 < y.sum() < len(y) else np.empty(0, np.int64)
    at = [np.searchsorted(terms, r[np.isin(r, terms)]) for r in rows] if len(terms) else []
    m = FactorizationMachine(p.hash_bits, terms, float(np.log(base / (1 - base))),
                             np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), p.factors)))
    if not len(terms):
        return m
    weight = weight / weight.mean()
    gb, gw, gv = 1e-2, np.full(len(terms), 1e-2), np.full((len(terms), p.factors), 1e-2)
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), 256):
            ids = order[s:s + 256]
            term = np.concatenate([at[i] for i in ids])
            doc = np.repeat(np.arange(len(ids)), [len(at[i]) for i in ids])
            z = fm_logits(m.bias, m.weight, m.factor, doc, term, len(ids))
            g = (sigmoid(z) - y[ids]) * weight[ids] / len(ids)
            db = g.sum()
            gb += db * db
            m.bias -= p.rate * db / np.sqrt(gb)
            seen = np.unique(term)
            dw = np.bincount(term, g[doc], len(terms))[seen] + p.l2 * m.weight[seen]
            sums = np.stack([np.bincount(doc, m.factor[term, f], len(ids)) for f in range(p.factors)], 1)
            dv = np.stack([np.bincount(term, g[doc] * (sums[doc, f] - m.factor[term, f]), len(terms))[seen]
                           for f in range(p.factors)], 1) + p.l2 * m.factor[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            m.weight[seen] -= p.rate * dw / np.sqrt(gw[seen])
            m.factor[seen] -= p.rate * dv / np.sqrt(gv[seen])
    return m


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, params: FMParams = FMParams(),
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fit on labelled documents; ``train_on`` is a condition on the label rows' id.

    Rows with a null label, id or text are left out.  A document labelled twice
    counts once for each label row.
    """
    spark = docs.sparkSession
    known = (labels.where(train_on & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")))
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    chosen = sample_rows(spark, known, "_id", "_y", params.per_class, params.seed)
    # The sample is bounded by per_class, so its ids may be broadcast; the texts stay where they are.
    rows = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
            .join(F.broadcast(chosen), "_id"))
    bits = params.hash_bits

    def terms_of(b: pa.RecordBatch):
        for start, part in T.chunks(b.column("_t").to_pylist()):
            bucket, doc = term_buckets(part, bits)
            out = [np.unique(bucket[doc == i]).astype(np.int32) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").slice(start, len(part)).cast(pa.string()), b.column("_y").slice(start, len(part)),
                 pa.array(out, pa.list_(pa.int32()))], names=["id", "y", "terms"])

    # Sorted by content, so that the fit does not depend on partitioning.
    table = map_batches(rows, terms_of, "id string, y int, terms array<int>").toArrow()
    got = sorted(zip(table.column("id").to_pylist(), table.column("y").to_pylist(), lists_of(table, "terms"), strict=True),
                 key=lambda r: (r[0], r[1], r[2].tobytes()))
    y = np.array([r[1] for r in got], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([total.get(int(c), 1) / n[int(c)] for c in y])
    return train([r[2] for r in got], y, weight, params)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row, in one pass without a shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch):
        for start, part in T.chunks(b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(start, len(part)), pa.array(sigmoid(model.logits(part)))], names=["id", "score"])

    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                      f"id {id_type}, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return (score(docs, model)
            .select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more go; the others keep their columns.

    Scores and texts stay in one row, so nothing is joined or shuffled.
    """
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    names = docs.columns

    def run(b: pa.RecordBatch):
        keep = np.concatenate([sigmoid(model.logits(part)) < 0.5
                               for _, part in T.chunks(b.column("text").to_pylist())])
        yield b.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema).select(*names)
