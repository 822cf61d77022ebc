"""Language identification with string kernels.

The kernel is the blended spectrum presence kernel: two texts are compared by
the character n-grams of length 1 to 3 that both have, k(x, y) =
|G(x) & G(y)| / sqrt(|G(x)| |G(y)|).  n-grams are taken of the text with letters
lower-cased, all else one blank, and hashed into ``2**hash_bits`` buckets; those
that occur in two training texts at least, the most frequent ``max_grams`` (first
an equal share of each language's own, then those of all), count.

``landmarks`` training texts give a Nystroem map, K(x, L) K(L, L)^-1/2, and on
it a kernel ridge regression of +1 / -1 is solved for each language against the
rest.  Scoring a batch is three matrix products: presence (texts x n-grams)
times the landmarks' presence, scaled to the kernel, times the dual weights.

The fit uses a bounded sample: ``per_class`` texts of each language in
expectation, chosen by a seeded hash, each with a short run of its words beside
it, so that short texts have landmarks like them.  Scoring reads whole texts.

A text that is null or has no letter is ``und`` with score 0.  A text whose
n-grams are all unknown gets the language the intercepts favour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm import text as T
from shiftspark.llm.common import lists_of, map_batches, read_table, sample_rows

UNDETERMINED = "und"


@dataclass(frozen=True)
class KernelParams:
    longest: int = 3
    hash_bits: int = 18
    max_grams: int = 4096
    per_class: int = 300
    landmarks: int = 192
    ridge: float = 1e-2
    short_words: int = 8
    seed: int = 3


_LETTERS: dict[str, np.ndarray] = {}


def _letters(cps: np.ndarray) -> np.ndarray:
    """Lower-cased letters; 0 for every other code point."""
    if "t" not in _LETTERS:
        t = np.zeros(T.TABLE_END, np.uint32)
        for cp in range(T.TABLE_END):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _LETTERS["t"] = t
    t = _LETTERS["t"]
    return np.where(cps < T.TABLE_END, t[np.minimum(cps, T.TABLE_END - 1)], 0)


def grams(texts: list[str], p: KernelParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of all n-grams, repeats included; whether each text has a letter."""
    cps = T.code_points("\n" + "\n".join(texts) + "\n")
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    low = _letters(cps).astype(np.uint64)
    has = np.zeros(len(texts), bool)
    inside = np.flatnonzero(low[1:])
    has[owner[inside]] = True
    # A run of blanks counts once; the one between two texts ends one and begins the other.
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0)
    of = np.concatenate([[0], owner])[keep]
    low = low[keep]
    total, code = len(low), np.zeros(len(low), np.uint64)
    buckets, texts_of = [], []
    for n in range(1, p.longest + 1):
        if total < n:
            break
        code = code[:total - n + 1] * np.uint64(0x100000001B3) + low[n - 1:] + np.uint64(1)
        last = of[n - 1:]
        at = np.flatnonzero(low > 0 if n == 1 else of[1:total - n + 2] == last)
        b = T.mix64(code[at] + np.uint64(n)) >> np.uint64(64 - p.hash_bits)
        buckets.append(b.astype(np.int32))
        texts_of.append(last[at])
    return np.concatenate(buckets), np.concatenate(texts_of), has


@dataclass
class LanguageModel:
    params: KernelParams
    languages: list[str]
    index: np.ndarray                    # bucket -> column, -1
    landmarks: np.ndarray                # n-grams x landmarks, scaled to unit kernel
    dual: np.ndarray                     # landmarks x languages
    intercept: np.ndarray

    def presence(self, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        column = self.index[bucket]
        known = column >= 0
        x = np.zeros((n, self.landmarks.shape[0]), np.float32)
        x[owner[known], column[known]] = 1
        return x

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bucket, owner, has = grams(texts, self.params)
        x = self.presence(bucket, owner, len(texts))
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        f = (x @ self.landmarks / norm) @ self.dual + self.intercept
        best = f.argmax(axis=1)
        score = np.where(has, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], score


def train(rows: list[np.ndarray], langs: list[str], weight: np.ndarray, p: KernelParams) -> LanguageModel:
    """Nystroem features and one-versus-rest ridge of the texts' bucket sets."""
    names = sorted(set(langs))
    df = np.zeros(1 << p.hash_bits, np.int64)
    for r in rows:
        df[r] += 1
    seen = np.flatnonzero(df >= 2)
    # Each language's most frequent n-grams, an equal share of them; then those of all.
    share, parts = max(1, p.max_grams // len(names)), []
    for name in names:
        own = np.bincount(np.concatenate([r for r, g in zip(rows, langs, strict=True) if g == name]), minlength=1 << p.hash_bits)[seen]
        parts.append(seen[np.lexsort((seen, -own))][:min(share, np.count_nonzero(own))])
    chosen = np.unique(np.concatenate(parts))
    rest = np.setdiff1d(seen, chosen)
    fill = rest[np.lexsort((rest, -df[rest]))][:max(0, p.max_grams - len(chosen))]
    chosen = np.sort(np.concatenate([chosen, fill]))
    index = np.full(1 << p.hash_bits, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), max(1, len(chosen))), np.float32)
    for i, r in enumerate(rows):
        c = index[r]
        x[i, c[c >= 0]] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    y = np.array([names.index(v) for v in langs])
    rng = np.random.default_rng(p.seed)
    # As many landmarks of each language as there are, at most an equal part.
    part = -(-p.landmarks // len(names))
    marks = np.concatenate([np.sort(rng.permutation(np.flatnonzero(y == c))[:part]) for c in range(len(names))])
    k_xl, k_ll = (x @ x[marks].T).astype(np.float64), (x[marks] @ x[marks].T).astype(np.float64)
    value, vector = np.linalg.eigh(k_ll)
    root = vector / np.sqrt(np.maximum(value, 1e-4)) @ vector.T
    z = np.concatenate([k_xl @ root, np.ones((len(rows), 1))], axis=1)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = weight / weight.mean()
    gram = z.T @ (z * w[:, None]) + p.ridge * len(rows) / 100 * np.diag([*np.ones(len(marks)), 0])
    beta = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), z.T @ (target * w[:, None]))
    return LanguageModel(p, names, index, np.ascontiguousarray(x[marks].T), (root @ beta[:-1]).astype(np.float32),
                         beta[-1].astype(np.float32))


def fit(docs: DataFrame, train_on: Column, params: KernelParams = KernelParams(), id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on rows that meet ``train_on`` with a language; None if there are none."""
    rows = docs.where(train_on & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    chosen = sample_rows(docs.sparkSession, rows, "id", "lang", params.per_class, params.seed)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in T.chunks(b.column("text").to_pylist()):
            n = params.short_words
            words = [t.split() for t in part]
            cut = [" ".join(w[len(w) // 3:len(w) // 3 + n]) for w in words]
            for texts in (part, cut):
                bucket, owner, has = grams(texts, params)
                got = [np.unique(bucket[owner == i]) if has[i] else np.empty(0, np.int32) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(start, len(part)), b.column("lang").slice(start, len(part)),
                     pa.array(got, pa.list_(pa.int32()))], names=["id", "lang", "grams"])

    table = map_batches(chosen, run, "id string, lang string, grams array<int>").toArrow()
    got = sorted((r for r in zip(table.column("lang").to_pylist(), table.column("id").to_pylist(), lists_of(table, "grams"), strict=True)
                  if len(r[2])), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    if not got:
        return None
    langs = [r[0] for r in got]
    return train([r[2] for r in got], langs, np.ones(len(got)), params)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score of every row, in one pass without a shuffle.

    Without a model (nothing to learn from) every text is ``und``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, part in T.chunks(b.column(1).to_pylist(), 250_000):
            ids = b.column(0).slice(start, len(part))
            langs, score = model.predict(part) if model else ([UNDETERMINED] * len(part), np.zeros(len(part)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs), pa.array(score, pa.float64())],
                                             names=["id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                       f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    got = identify(docs, fit(docs, ~held_out()))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
