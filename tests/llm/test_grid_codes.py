"""Vector codes against a brute-force version."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import CLASHING
from shiftspark.llm import grid_codes as G


def brute_force(rows):
    """(id, code, error, label_error) and the codebooks' digest of (id, vector, label) rows."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-2**26, min(2**26, math.floor(256 * x))) for x in v], label))
    dim = -(-max(1, max((len(v) for _, v, _ in kept), default=1)) // 16) * 16
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    part = dim // 16

    def cut(v, p):
        return v[p * part:(p + 1) * part]

    books = [[cut(v, p) for _, v, _ in kept[:64]] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            got = {}
            for _, v, _ in kept:
                got.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, parts in got.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    out, by_label = [], {}
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(16)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    text = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(((str(i), code, e, by_label[label]) for i, code, e, label in out)), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, extra=True):
    schema = "vec_id long, embedding array<float>, label int"
    if extra:
        schema += "".join(f", {c} string" for c in [*CLASHING, "v", "code", "p", "e", "n"] if c not in ("label",))
        n = len(schema.split(", ")) - 3
        full = [(*r, *["x"] * n) for r in rows]
    else:
        full = rows
    got = G.vector_codes(spark.createDataFrame(full, schema).repartition(3)).collect()
    want, digest = brute_force(rows)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want
    assert {r[4] for r in got} <= {digest}


def random_rows(n, dim, seed, spread=0.2):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in r.normal(0, spread, dim)], int(r.integers(0, 4))) for i in range(n)]


def test_against_brute_force(spark):
    rows = random_rows(220, 32, 1)
    check(spark, [(i * 3 % 220, v, label) for i, v, label in rows])


def test_dropped_rows_ties_repeats_and_null_labels(spark):
    rows = random_rows(80, 16, 2, 0.01)                     # few different whole numbers: many ties
    rows += [(3, rows[3][1], None), (3, rows[3][1], None), (None, rows[5][1], 1), (7, rows[9][1], 2)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, 2),
             (-5, [float("-inf")] * 16, None)]
    check(spark, rows)


def test_short_long_and_huge_vectors(spark):
    rows = random_rows(30, 16, 3)
    rows += [(100, [], 0), (101, [0.5], 1), (102, [1e30] * 16, 0), (103, [-1e30] * 20, 1), (104, [3.4e38] * 3, 0)]
    check(spark, rows)


def test_fewer_vectors_than_entries_and_empty_table(spark):
    check(spark, random_rows(5, 48, 4))
    check(spark, [])
    check(spark, [(1, None, 2)], extra=False)


def test_doubles_and_other_id_types(spark):
    df = spark.createDataFrame([("b", [0.1] * 16, "x"), ("a", [0.2] * 16, "x")], "k string, vec array<double>, kind string")
    got = G.vector_codes(df, "k", "vec", "kind").orderBy("k").collect()
    assert [r.k for r in got] == ["a", "b"] and got[0].code == "00" * 16 and got[1].code == "01" * 16


@pytest.mark.parametrize("held", [1, 50, G.CELLS_HELD])
def test_cells_keep_every_nearest_entry(monkeypatch, held):
    monkeypatch.setattr(G, "CELLS_HELD", held)
    r = np.random.default_rng(5)
    book = r.integers(-60, 60, (64, 4))
    book[10] = book[40]                                      # a tie: the lower index wins
    points = np.concatenate([r.integers(-90, 90, (4000, 4)), book])
    grid = G.Grid.of(book)
    for part in np.array_split(points, 7):
        i, d = grid.nearest(part)
        dist = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        assert (i == dist.argmin(axis=1)).all() and (d == dist.min(axis=1)).all()
    if held == G.CELLS_HELD:
        assert np.mean([len(e) for e in grid.kept]) < 32     # dominated entries are left out


def test_an_arrow_slice_is_read_at_its_own_rows():
    import pyarrow as pa
    v = pa.array([[0.0, 1.0], None, [2.0], [float("nan"), 1.0], [3.0, None], [4.0]], pa.list_(pa.float64())).slice(2)
    at, begin, held = G.whole_numbers(v)
    assert at.tolist() == [0, 3] and begin.tolist() == [0, 1, 2] and held.tolist() == [512, 1024]


def test_hot_label_is_summed_before_it_is_joined(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") % 7).cast("float")] * 16).alias("embedding"),
                                 F.when(F.col("id") % 3 == 0, 1).alias("label"))
    got = G.vector_codes(df)
    sums = {r.label_error for r in got.select("label_error").distinct().collect()}
    assert sums == {0}                                       # seven different vectors, each an entry
