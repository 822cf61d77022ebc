"""Exact dedup, near-duplicate classes, repeated passages, decontamination."""

import datetime
import decimal
import collections
import hashlib
import random
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftspark.llm import cuckoo, decontaminate, near_dup, suffixes
from shiftspark.llm import text as T
from llm_helpers import WORD, documents, edge_rows, empty_documents, sentence, shingle_set, word_list

NORMAL = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(i: int) -> tuple[bytes, int]:
    return hashlib.sha256(str(i).encode()).digest(), i


# --- text -------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé ß1_-\n", max_size=40), max_size=6))
def test_words_are_alphanumeric_runs_with_offsets(texts):
    h, doc, begin, end = T.words(texts)
    got = [(int(d), texts[d][b:e]) for d, b, e in zip(doc, begin, end)]
    want = [(i, m[0]) for i, t in enumerate(texts) for m in WORD.finditer(t)]
    assert got == want
    names = collections.defaultdict(set)
    for (_, w), x in zip(got, h):
        names[w.lower()].add(int(x))
    assert all(len(v) == 1 for v in names.values())
    assert len({min(v) for v in names.values()}) == len(names)


def test_shingles_equal_sets():
    texts = [sentence(1, 30), "a b c", "", "A B  c!", sentence(1, 29)]
    s, owner = T.shingles(texts)
    got = [set(s[owner == i].tolist()) for i in range(len(texts))]
    assert [len(g) for g in got] == [26, 1, 0, 1, 25]
    assert got[1] == got[3] and got[4] < got[0]


# --- cuckoo filter ----------------------------------------------------------

def test_index_inserts_deletes_and_resizes():
    ix = cuckoo.CuckooIndex(buckets=2, max_kicks=8)
    live = {}
    r = random.Random(4)
    for step in range(6000):
        k = digest(r.randrange(900))
        if r.random() < 0.35:
            assert (ix.delete(k) is not None) == (live.pop(k, None) is not None)
        else:
            new = ix.merge(k, step)
            assert new == (k not in live)
            live[k] = step
        if step % 500 == 0:
            assert {x[0]: x[1] for x in ix.items()} == live
    assert ix.resizes > 3 and len(ix) == len(live)
    assert all(ix.get(k)[0] == v for k, v in live.items())
    assert ix.get(digest(10_000)) is None and ix.delete(digest(10_000)) is None


def test_equal_fingerprints_do_not_merge_different_content():
    ix = cuckoo.CuckooIndex(buckets=2)
    a, b = bytes(32), bytes(16) + b"x" * 16           # same bucket and fingerprint, other content
    ix.merge((a, 1), 1)
    ix.merge((b, 1), 2)
    ix.merge((a, 2), 3)
    assert len(ix) == 3 and ix.get((a, 1)) == (1, 1) and ix.get((b, 1)) == (2, 1)


def brute_exact(rows):
    norm = [(i, (t or "").translate(NORMAL)) for i, t, *_ in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_on_edge_rows(spark):
    rows = edge_rows()
    got = cuckoo.dedup(documents(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)
    assert cuckoo.dedup(empty_documents(spark)).count() == 0


def test_only_ascii_letters_are_folded(spark):
    got = cuckoo.dedup(documents(spark, [(1, "ÀB", "x", "s"), (2, "àb", "x", "s"), (3, "Àb", "x", "s")])).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 3, 2: 2, 3: 3}


def test_index_update(spark):
    docs = documents(spark, [(i, f"text {i % 7}", "x", "s") for i in range(40)])
    index = cuckoo.build_index(cuckoo.digests(docs))
    assert index.agg({"copies": "sum"}).first()[0] == 40 and index.count() == 7
    gone = cuckoo.digests(documents(spark, [(0, "text 3", "x", "s"), (1, "TEXT 5", "x", "s"), (2, "no such", "x", "s")]))
    new = cuckoo.digests(documents(spark, [(99, "text 5", "x", "s"), (98, "text 1", "x", "s"), (97, "fresh", "x", "s")]))
    after = cuckoo.update_index(index, new, gone).collect()
    by = {bytes(r["digest"]): (r["best"], r["copies"]) for r in after}
    key = lambda t: hashlib.sha256(t.encode()).digest()
    assert len(after) == 7 and key("text 3") not in by
    assert by[key("text 5")] == (99, 1) and by[key("text 1")] == (98, 7) and by[key("fresh")] == (97, 1)


def test_drop_copies_keeps_one_row_of_each_text(spark):
    docs = documents(spark, edge_rows())
    kept = cuckoo.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    best = {}
    for i, t, *_ in edge_rows():
        k = (t or "").translate(NORMAL)
        if k not in best or best[k][0] is None or i is not None and i > best[k][0]:
            best[k] = (i, t)
    assert [(a, (b or "").translate(NORMAL)) for a, b in got] == sorted(((i, k) for k, (i, t) in best.items()), key=str) or \
        {(a, (b or "").translate(NORMAL)) for a, b in got} == {(i, k) for k, (i, _) in best.items()}
    assert len(got) == len(best)


# --- near duplicates ---------------------------------------------------------

def test_prob_min_hash_estimates_probability_jaccard():
    r = np.random.default_rng(3)
    n = 300
    e = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wa, wb = r.gamma(1, 1, n) + 0.01, r.gamma(1, 1, n) + 0.01
    wb[:200] = wa[:200] * 3                       # scale is irrelevant to probability Jaccard
    both = np.concatenate([e, e])
    m = 4096
    sig = near_dup.prob_min_hash(both, np.concatenate([wa, wb]), np.repeat([0, 1], n), 2, m)
    want = sum(1 / np.maximum(wa / wa[d], wb / wb[d]).sum() for d in range(n))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5
    assert set(sig[0]) <= set(e.tolist())


def test_prob_min_hash_of_small_and_empty_sets():
    e = np.array([7, 7, 9], np.uint64)
    sig = near_dup.prob_min_hash(e, np.ones(3), np.array([0, 2, 2]), 3, 32)
    assert (sig[0] == 7).all() and (sig[1] == 0).all() and set(sig[2]) == {7, 9}


def brute_classes(rows, least=0.8):
    sets = [shingle_set(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = len(a & b) >= least * len(a | b) if a and b else (rows[i][1] or "") == (rows[j][1] or "") and not a and not b
            if same:
                up[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i, r in enumerate(rows):
        out[find(i)].append(r[0])
    return sorted(sorted(map(str, v)) for v in out.values())


def classes_of(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["label"]].append(str(r["id"]))
    return sorted(sorted(v) for v in out.values())


def changed(words, seed, n):
    r, w = random.Random(seed), list(words)
    for i in r.sample(range(len(w)), n):
        w[i] = "x" + w[i]
    return w


def test_classes_equal_brute_force(spark):
    rows = []
    shared = word_list(900, 80)
    for g in range(12):
        base = word_list(g, 120)
        for c in range(5):
            rows.append((len(rows), " ".join(changed(base, 100 * g + c, c)), "en", "s"))
    for g in range(30):                              # half of each text is one common passage
        rows.append((len(rows), " ".join(word_list(500 + g, 80) + shared), "en", "s"))
    chain = word_list(77, 400)                       # each like the next one, the ends unlike
    for c in range(6):
        rows.append((len(rows), " ".join(["y" + w if i < 15 * c else w for i, w in enumerate(chain)]), "en", "s"))
    rows += edge_rows()
    got = near_dup.near_duplicates(documents(spark, rows).repartition(4))
    assert classes_of(got) == brute_classes(rows)


def test_hot_bucket_of_unlike_texts_loses_no_pair(spark, monkeypatch):
    """With one weak band all texts meet in few buckets; every pair must still be tested."""
    monkeypatch.setattr(near_dup, "FIRST_HUBS", 2)
    monkeypatch.setattr(near_dup, "LEAST_AGREE", 0.0)
    rows = [(i, " ".join(word_list(1, 60) + changed(word_list(50 + i // 2, 40), i, 1)), "en", "s") for i in range(24)]
    df = near_dup.near_duplicates(documents(spark, rows))
    assert classes_of(df) == brute_classes(rows)


def test_pairs_on_both_sides_of_a_round_of_hubs_meet(spark, monkeypatch):
    """The most common class of a part changes between rounds; the pair (3, 39) needs the first one."""
    real = near_dup.sketch
    one = F.array(F.lit(1).cast("long"))
    monkeypatch.setattr(near_dup, "sketch", lambda *a: real(*a).withColumn("bands", one))
    monkeypatch.setattr(near_dup, "_prefixes", lambda sets: sets.select("uid", F.lit(1).cast("long").alias("band")))
    rows = [(i, sentence(4000 + {39: 3, 7: 5}.get(i, i), 100) + (" and more" if i in (39, 7) else ""), "en", "s") for i in range(40)]
    assert len(rows) > near_dup.FIRST_HUBS
    got = near_dup.near_duplicates(documents(spark, rows).coalesce(1))
    assert classes_of(got) == brute_classes(rows)


def crowd(n_common, seeds):
    common = word_list(1, n_common)
    return [" ".join(common + changed(word_list(50 + s, 30), i, 1)) for i, s in enumerate(seeds)]


def short_sets(spark, texts):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    members = near_dup.sketch(docs).select(F.col("id").alias("uid"), F.col("id").alias("key"), "digest")
    return near_dup._short_sets(members, docs.select(F.col("doc_id").alias("key"), "text"))


@pytest.mark.parametrize("cells", [1, 64, near_dup.CELLS])
def test_similar_sets_share_a_prefix_shingle(spark, monkeypatch, cells):
    """Exact for any number of cells, also where all shingles share one."""
    monkeypatch.setattr(near_dup, "CELLS", cells)
    texts = crowd(60, [i // 3 for i in range(30)]) + ["one", "one two three four", " ".join(["again"] * 50), "a b c d e f"] * 2
    got = collections.defaultdict(set)
    for r in near_dup._prefixes(short_sets(spark, texts)).collect():
        got[r["uid"]].add(r["band"])
    sets = [shingle_set(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) >= 15
    assert all(got[i] & got[j] for i, j in alike)


def test_lists_of_sets_meet_as_by_brute_force():
    """Whole and thinned sets, slices of lists; of one class a member needs one hub."""
    r = np.random.default_rng(1)
    rows = []
    for i in range(60):
        n = int(r.choice([1, 5, 100, 2000, 2100, 4500, 9000]))
        base, own = (x.integers(0, 2 ** 32, n, dtype=np.uint32) for x in (np.random.default_rng(n), r))
        rows.append((i // 2, np.unique(np.where(r.random(n) < r.choice([0.86, 0.9, 0.95, 1.0]), base, own))))
    kind = pa.struct([("uid", pa.int64()), ("rank", pa.int32()), ("label", pa.int64()), ("main", pa.bool_()),
                      ("n", pa.int32()), ("thin", pa.list_(pa.int32()))])
    listed = pa.array([{"uid": i, "rank": i, "label": g, "main": False, "n": len(v), "thin": near_dup._thinned(v).view(np.int32)}
                       for i, (g, v) in enumerate(rows)], kind)
    got = {(a + 10, b + 5) for a, b in zip(*near_dup._alike(listed.slice(10, 30), listed.slice(5, 50)), strict=True)}

    def similarity(a, b):
        return len(np.intersect1d(rows[a][1], rows[b][1])) / len(np.union1d(rows[a][1], rows[b][1]))

    want = {(a, b) for a in range(10, 40) for b in range(5, min(55, a)) if rows[a][0] != rows[b][0] and similarity(a, b) >= 0.8}
    assert len(want) > 40
    assert {(a, rows[b][0]) for a, b in want} <= {(a, rows[b][0]) for a, b in got}
    assert all(similarity(a, b) >= 0.72 or len(rows[a][1]) <= 5 for a, b in got)


def test_a_common_passage_makes_no_pairs(spark):
    """Texts with nothing else in common share no prefix, however many there are."""
    texts = crowd(100, range(60))
    of = near_dup._prefixes(short_sets(spark, texts)).withColumn("label", F.col("uid"))
    assert near_dup._mixed(of).count() == 0


def test_bands_of_the_same_members_are_one(spark):
    rows = [(u, b, u) for b in range(5) for u in (1, 2, 3)] + [(u, 9, u) for u in (1, 2)] + [(4, 11, 4), (5, 11, 4)]
    of = spark.createDataFrame(rows, "uid long, band long, label long")
    assert sorted(r["band"] for r in near_dup._mixed(of).collect()) == [0, 9]


def test_copies_that_repeat_a_passage_are_found(spark):
    rows = []
    for g in range(12):
        base = word_list(6000 + g, 104)
        rows += [(2 * g, " ".join(base), "en", "s"), (2 * g + 1, " ".join(base[:40] + base[20:40] * 999 + base[40:]), "en", "s")]
    want = brute_classes(rows)
    assert len(want) == 12
    assert classes_of(near_dup.near_duplicates(documents(spark, rows))) == want


def test_one_row_of_each_class_stays(spark):
    base = word_list(3, 100)
    rows = [(5, " ".join(base), "en", "s"), (4, " ".join(changed(base, 1, 1)), "en", "s"), (4, " ".join(changed(base, 1, 1)), "en", "s"),
            (9, "alone here", "en", "s"), (None, " ".join(base), "en", "s")]
    docs = documents(spark, rows)
    c = {(r["doc_id"], r["kept"]): r for r in near_dup.classes(docs).collect()}
    assert c[5, False]["class_id"] == 4 and c[5, False]["class_size"] == 4 and c[9, True]["class_id"] == 9
    out = near_dup.keep_one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [4, 9]
    assert near_dup.keep_one_of_each(spark, empty_documents(spark), "").count() == 0
    assert near_dup.classes(empty_documents(spark)).count() == 0


# --- repeated passages -------------------------------------------------------

def brute_spans(rows):
    n = suffixes.MIN_WORDS
    docs = {(i, t or "") for i, t, *_ in rows}
    toks = {d: [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(d[1])] for d in docs}
    seen = collections.defaultdict(set)
    for d, w in toks.items():
        for s in range(len(w) - n + 1):
            seen[tuple(x[0] for x in w[s:s + n])].add(d[1])
    texts = collections.defaultdict(set)
    for i, t in docs:
        texts[t].add(i)
    out = set()
    for d, w in toks.items():
        hit = [s for s in range(len(w) - n + 1) if len(seen[tuple(x[0] for x in w[s:s + n])]) > 1 or len(texts[d[1]]) > 1]
        a = z = None
        for s in [*hit, None]:
            if a is not None and (s is None or s > z):
                out.add((d[0], a, z, w[a][1], w[z - 1][2]))
                a = None
            if s is not None:
                a, z = (s if a is None else a), s + n
    return out


def test_spans_equal_brute_force(spark):
    p, q = word_list(1, 70), word_list(2, 55)
    rows = [(1, " ".join(word_list(10, 40) + p + word_list(11, 30)), "en", "s"), (2, " ".join(p + word_list(12, 20)), "en", "s"),
            (3, " ".join(word_list(13, 90) + p[:49]), "en", "s"), (4, " ".join(q + q + word_list(14, 9)), "en", "s"),
            (5, ", ".join(word_list(15, 3) + [w.upper() for w in p[10:]] + q), "en", "s"), (6, sentence(16, 200), "en", "s"), (7, sentence(16, 200), "en", "s"),
            (8, " ".join(p[:30] + q[:40] + p[30:]), "en", "s"), (9, " ".join(word_list(17, 10) * 20), "en", "s"), *edge_rows()]
    got = suffixes.repeated_spans(documents(spark, rows).repartition(3))
    assert {tuple(r) for r in got.collect()} == brute_spans(rows)
    assert got.count() == len(brute_spans(rows))
    assert suffixes.repeated_spans(empty_documents(spark)).count() == 0


def test_argmin_takes_the_first_of_equals():
    r = np.random.default_rng(1)
    for width in (1, 2, 7):
        x = r.integers(0, 5, 40).astype(np.uint64) << np.uint64(20)
        want = [i + int(np.argmin(x[i:i + width])) for i in range(40 - width + 1)]
        assert suffixes.sliding_argmin(x, width).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=30), st.lists(st.integers(1, 6), max_size=8), st.lists(st.integers(0, 30), max_size=4))
def test_neighbours_over_tasks_and_batches(rows, sizes, cuts):
    """Any split of the sorted rows into tasks and batches finds the same rows."""
    rows = sorted((k, u, i) for i, (k, u) in enumerate(rows))
    bounds = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    yes, undecided, ends = [], [], collections.defaultdict(set)
    for a, z in zip(bounds, bounds[1:]):
        batches, i, n = [], a, 0
        while i < z:
            step = sizes[n % len(sizes)] if sizes else 100
            part = rows[i:min(z, i + step)]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                                                       *[pa.array([r[2] for r in part], pa.int32())] * 3], names=suffixes._NAMES))
            i, n = i + step, n + 1
        for out in suffixes._neighbours(iter(batches)):
            for r in out.to_pylist():
                if r["state"] == 2:
                    ends[r["key"]].add(r["uid"])
                else:
                    (yes if r["state"] else undecided).append((r["key"], r["uid"], r["first"]))
    got = sorted(yes + [r for r in undecided if len(ends[r[0]]) > 1])
    uids = collections.defaultdict(set)
    for k, u, _ in rows:
        uids[k].add(u)
    assert got == [r for r in rows if len(uids[r[0]]) > 1]


# --- decontamination ---------------------------------------------------------

def brute_hits(docs, items):
    out = set()
    for i, t, *_ in docs:
        d = shingle_set(t)
        for j, u in items:
            s = shingle_set(u)
            if s and len(s & d) >= 0.8 * len(s):
                out.add((i, j, len(s & d) / len(s)))
    return out


@pytest.fixture
def benchmark_items(spark):
    rows = [(k, sentence(3000 + k, n)) for k, n in enumerate((5, 6, 9, 13, 17, 20, 33, 40, 64, 70, 100, 3))]
    return [*rows, (90, None), (91, ""), (92, "!!!"), (5, sentence(3005, 20)), (None, sentence(3100, 12))]


def test_search_equals_brute_force(spark, benchmark_items):
    docs = []
    for k, (i, t) in enumerate(benchmark_items):
        w = WORD.findall(t or "")
        docs.append((100 + k, " ".join(word_list(k, 700) + w + word_list(k + 40, 300)), "en", "s"))
        docs.append((200 + k, " ".join(word_list(k, 20) + w[:len(w) * 9 // 10] + word_list(k + 80, 5)), "en", "s"))
        docs.append((300 + k, " ".join(word_list(k + 5, 50) + w[:len(w) // 2]), "en", "s"))
        docs.append((400 + k, (t or "").upper(), "en", "s"))
    docs += edge_rows()
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    got = decontaminate.search(documents(spark, docs), items)
    assert {tuple(r) for r in got.collect()} == brute_hits(docs, benchmark_items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(documents(spark, docs), none).count() == 0
    assert decontaminate.search(empty_documents(spark), items).count() == 0


def test_ids_of_any_type_and_rows_that_repeat_an_id(spark):
    item = sentence(3, 20)
    words = item.split()
    docs = documents(spark, [(1, item, "en", "a"), (1, item, "en", "a"), (2, " ".join(words[:12]), "en", "a"), (2, " ".join(words[8:]), "en", "a")])
    for kind, value in (("smallint", 7), ("date", datetime.date(2024, 1, 2)), ("decimal(9,2)", decimal.Decimal("7.25")), ("string", "x")):
        items = spark.createDataFrame([(value, item)], f"item_id {kind}, text string")
        got = decontaminate.search(docs, items)
        assert dict(got.dtypes)["item_id"] == kind
        assert [(r.doc_id, r.item_id, r.containment) for r in got.collect()] == [(1, value, 1.0)] * 2


def test_blocks_of_items_find_the_same(spark, benchmark_items, monkeypatch):
    docs = documents(spark, [(k, t, "en", "s") for k, t in benchmark_items])
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    one = sorted(map(str, decontaminate.search(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 80)
    assert sorted(map(str, decontaminate.search(docs, items).collect())) == one


def test_contaminated_documents_go(spark, tmp_dir, benchmark_items):
    from llm_helpers import write_tables
    sf = write_tables(tmp_dir, spark, benchmark=spark.createDataFrame(benchmark_items, "item_id long, text string"))
    dirty = (50, "before it " + benchmark_items[7][1] + " after it", "en", "s")
    docs = documents(spark, [*edge_rows(), dirty])
    out = decontaminate.drop_contaminated(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(r[0]) for r in edge_rows())
