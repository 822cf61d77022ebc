"""Forests of many data sets against a learner that grows one tree at a time; backtest."""

import collections
import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators import features as FE
from shiftspark.operators import forests as FO
from shiftspark.sources.tables import Fixtures

from conftest import SF_SMALL

P = FO.ForestsParams(num_trees=4, max_depth=4)
SCHEMA = "dataset_id string, id string, date date, start_time_by_minutes double, end_time_by_minutes double"
DAY = dt.date(2024, 1, 1)


def draws(row, tree, seed):
    text = ":".join([str(seed), str(tree), row["id"], str(row["date"]), str(int(row[K.START])), str(int(row[K.END]))])
    u = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return sum(u >= t for t in FO.POISSON_STEPS)


def grow(rows, node, level, depth, out):
    """``rows``: (weight, features, label)."""
    n, s = sum(w for w, _, _ in rows), sum(w * y for w, _, y in rows)
    best = None
    if level < depth and len({y for _, _, y in rows}) > 1:
        for f in range(len(K.FEATURES)):
            values = sorted({x[f] for _, x, _ in rows})
            for a, b in zip(values, values[1:]):
                left = [(w, y) for w, x, y in rows if x[f] <= a]
                nl, sl = sum(w for w, _ in left), sum(w * y for w, y in left)
                score = float(sl) * float(sl) / nl + float(s - sl) * float(s - sl) / (n - nl)
                if best is None or score > best[0]:
                    best = (score, f, (a + b) / 2)
    out[node] = (n, s * FO.MICRO // n, best and best[1], best and best[2])
    if best:
        for child, side in ((2 * node, True), (2 * node + 1, False)):
            grow([r for r in rows if (r[1][best[1]] <= best[2]) == side], child, level + 1, depth, out)


def sample(n=260, seed=4):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        ds = r.choice(("hot", "hot", "b", "c"))
        start = 60 * r.randint(6, 9) + (30 if ds == "b" else 0)
        rows.append((ds, f"e{r.randint(0, 9)}", DAY + dt.timedelta(r.randint(0, 80)), float(start), float(start + 400 + r.randint(0, 90))))
    rows += rows[:20]                                   # repeated rows are drawn together
    rows += [("one", "e1", DAY, 480.0, 960.0), ("flat", "e1", DAY, 480.0, 900.0), ("flat", "e2", DAY, 480.0, 960.0)]
    rows += [(None, "e1", DAY, 480.0, 960.0), ("b", None, DAY, 480.0, 960.0), ("b", "e1", None, 480.0, 960.0), ("b", "e1", DAY, None, 960.0)]
    return rows


def fitted(spark, rows, p=P, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    index = FE.id_index(df)
    return df, index, FE.training_frame(df, index)


def test_every_node_equals_a_tree_grown_alone(spark):
    _, _, train = fitted(spark, sample())
    want = collections.defaultdict(dict)
    whole = [r.asDict() for r in train.collect()]
    whole = [r for r in whole if all(r[c] is not None for c in ("dataset_id", *FO.DRAW_KEYS))]
    for ds in {r["dataset_id"] for r in whole}:
        for tree in range(P.num_trees):
            drawn = [(draws(r, tree, P.seed), [r[c] for c in K.FEATURES], r) for r in whole if r["dataset_id"] == ds]
            for target, label in FO.TARGETS.items():
                rows = [(w, x, int(r[label])) for w, x, r in drawn if w]
                if rows:
                    grow(rows, 1, 0, P.max_depth, want[ds, target, tree])
    got = collections.defaultdict(dict)
    for r in FO.fit_forests(train, P).collect():
        assert r["level"] == r["node"].bit_length() - 1
        got[r["dataset_id"], r["target"], r["tree"]][r["node"]] = (r["n"], r["value"], r["feature"], r["threshold"])
    assert got == want
    assert sum(v[2] is not None for t in got.values() for v in t.values()) > 100


def test_partitions_and_extra_columns_change_nothing(spark):
    _, _, a = fitted(spark, sample(), parts=1)
    _, _, b = fitted(spark, sample()[::-1], parts=7)
    b = b.withColumns({"tree": F.lit("clash"), "w": F.lit(3), "x": F.lit(1), "node": F.lit(9)})
    p = FO.ForestsParams(num_trees=2, max_depth=2)
    assert sorted(map(str, FO.fit_forests(a, p).collect())) == sorted(map(str, FO.fit_forests(b, p).collect()))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_last_level_has_no_cells(spark):
    """Its rows are summed by node; only levels that may split look at every value."""
    rows = spark.createDataFrame([("d", "start", 0, 1, 2, [1, 2, 3, 4, 5, 6], 480), ("d", "start", 0, 1, 1, [2, 2, 3, 4, 5, 6], 600), ("d", "end", 1, 3, 1, [0] * 6, 7)],
                                 "dataset_id string, target string, tree int, node long, w long, x array<int>, y long")
    last, split = FO.node_splits(rows, False), FO.node_splits(rows, True)
    assert "Window" not in executed(last) and "Generate" not in executed(last) and "Window" in executed(split)
    assert last.dtypes == split.dtypes
    assert sorted(map(tuple, last.collect())) == [("d", "end", 1, 3, 1, 7 * FO.MICRO, None, None), ("d", "start", 0, 1, 3, 520 * FO.MICRO, None, None)]
    assert sorted(map(tuple, split.collect())) == [("d", "end", 1, 3, 1, 7 * FO.MICRO, None, None), ("d", "start", 0, 1, 3, 520 * FO.MICRO, 0, 1.5)]


def test_a_draw_takes_one_digest_a_tree(spark):
    _, _, train = fitted(spark, sample(20))
    drawn = FO.draw(train.select(FO.DATASET, *FO.DRAW_KEYS), P)
    optimized = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("md5(") == 1


def test_rows_of_an_id_are_written_together(spark, monkeypatch):
    """However the training rows lie: so most of a node's cells of the id's code are whole before a shuffle."""
    written = {}

    def keep(df, name):
        written.setdefault(name, executed(df))
        return FO_write(df, name)

    FO_write = FO.write_and_read
    _, _, train = fitted(spark, sample(40), parts=5)
    monkeypatch.setattr(FO, "write_and_read", keep)
    FO.fit_forests(train, FO.ForestsParams(num_trees=1, max_depth=1))
    assert "REBALANCE_PARTITIONS_BY_COL" in written["forest-rows"]


def test_empty_history_has_no_nodes_and_no_predictions(spark):
    _, index, train = fitted(spark, sample())
    nodes = FO.fit_forests(train.limit(0), P)
    assert nodes.count() == 0
    days = spark.createDataFrame([("x", "e1", DAY, 0)], "dataset_id string, id string, date date, id_encoded int")
    assert [(r.pred_start, r.pred_end) for r in FO.predict(days, nodes, P).collect()] == [(None, None)]


def test_each_data_set_is_served_by_its_own_forest(spark):
    """One id in three data sets: recorded, predicted and unusable days; ids that a data set does not know are left out."""
    rows = [(ds, "a", DAY + dt.timedelta(i), s, e) for i in range(12) for ds, s, e in (("x", 480.0, 960.0), ("y", 600.0, 1000.0), ("z", 700.0, 650.0))]
    df, index, train = fitted(spark, rows + [("x", "b", DAY, 480.0, 960.0)])
    known = df.select("dataset_id", K.ID).distinct().join(index, K.ID)
    req = spark.createDataFrame([(d, i, DAY + dt.timedelta(12), 3) for d in "xyzw" for i in "ab"],
                                "dataset_id string, id string, target_date date, window_size int")
    req = req.unionByName(req.where("dataset_id = 'y'").withColumn("window_size", F.lit(1)))
    got = {(r.dataset_id, r.id, r.window_size, r.day.day): (r.start_time, r.end_time, r.historical)
           for r in FO.forecast_by_dataset(req, df, FO.fit_forests(train, P), known, P).collect()}
    times = {"x": ("08:00", "16:00"), "y": ("10:00", "16:40"), "z": ("NA", "NA")}
    want = {(d, "a", 3, day): (*times[d], False) for d in "xyz" for day in (13, 14)}
    want |= {("x", "a", 3, 12): ("08:00", "16:00", True), ("y", "a", 3, 12): ("10:00", "16:40", True), ("z", "a", 3, 12): ("11:40", "10:50", True)}
    want |= {("x", "b", 3, day): ("08:00", "16:00", False) for day in (12, 13, 14)} | {("y", "a", 1, 13): ("10:00", "16:40", False)}
    assert got == want


def test_backtest_trains_on_earlier_days_only(spark):
    """A pattern by id and weekday that changes at the last cut: only later cuts could know it."""
    rows = []
    for i in range(42):
        day = DAY + dt.timedelta(i)
        for j in range(6):
            start = 420.0 + 20 * day.weekday() + 30 * j + (200 if i >= 35 else 0)
            rows.append(("d", f"e{j}", day, start, start + (-200 if j == 5 else 480)))
    rows.append(("d", "late", DAY + dt.timedelta(30), 480.0, 960.0))
    df, index, _ = fitted(spark, rows)
    out = FO.backtest(df, index, 14, 7, FO.ForestsParams(num_trees=6, max_depth=7)).collect()
    assert collections.Counter(str(r.cut) for r in out) == {"2024-01-15": 42, "2024-01-22": 42, "2024-01-29": 43, "2024-02-05": 42}
    assert {(r.horizon, (r.date - r.cut).days + 1) for r in out} == {(h, h) for h in range(1, 8)}
    for r in out:
        if r.id == "late":
            assert not r.known and not r.usable and r.pred_start is None and r.base_start is None
        else:
            off = 200 if r.cut == dt.date(2024, 2, 5) else 0
            assert r.known and r[K.START] - r.base_start == off and abs(r[K.START] - r.pred_start - off) < 60
            assert r.usable == (r.id != "e5")
    errors = FO.backtest_errors(spark.createDataFrame(out), "cut").orderBy("cut").collect()
    assert [(e.n_days, e.n_unknown, e.n_na) for e in errors] == [(42, 0, 7), (42, 0, 7), (43, 1, 7), (42, 0, 7)]
    assert errors[0].baseline_error_start == 0 and errors[3].baseline_error_start == 200


def test_backtest_without_enough_days_is_empty(spark):
    df, index, _ = fitted(spark, [("d", "a", DAY, 480.0, 960.0)])
    assert FO.backtest(df, index, 14, 7, P).count() == 0
    assert FO.backtest(df.limit(0), index, 14, 7, P).count() == 0


def test_forecasts_beat_the_weekday_mean(spark):
    sched = Fixtures(spark, SF_SMALL).schedule()
    rows = FO.backtest(sched, FE.id_index(sched), 10, 5, FO.ForestsParams(num_trees=10, max_depth=5))
    e = FO.backtest_errors(rows).first()
    assert e.n_days > 50
    assert e.model_error_start < e.baseline_error_start and e.model_error_end < e.baseline_error_end
