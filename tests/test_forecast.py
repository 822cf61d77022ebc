"""Forecasts (F23, J1, J2, M5-M10) and model invariants (no oracle exists for forests)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators import features as FE
from shiftspark.operators import forecast as FC
from shiftspark.operators import model as M
from shiftspark.sources.tables import Fixtures

from conftest import SF_SMALL

SMALL_FOREST = M.ForestParams(num_trees=5, max_depth=6)


@pytest.fixture(scope="module")
def trained(spark):
    fx = Fixtures(spark, SF_SMALL)
    sched = fx.schedule().cache()
    index = FE.id_index(sched)
    fitted = M.fit_models(FE.training_frame(sched, index), SMALL_FOREST)
    return fx, sched, index, fitted


def test_history_rows_are_returned_unchanged(spark, trained):
    fx, sched, index, fitted = trained
    out = FC.forecast(fx.prediction_requests(), sched, fitted, index)
    hist = out.where("historical").join(
        sched.select(F.col(K.ID), F.col(K.DATE).alias("day"), K.START, K.END), [K.ID, "day"])
    bad = hist.where(
        (F.col("start_time") != F.format_string("%02d:%02d", (F.col(K.START) / 60).cast("int"),
                                                (F.col(K.START) % 60).cast("int"))))
    assert hist.count() > 0 and bad.count() == 0


def test_predictions_inside_label_range(spark, trained):
    fx, sched, index, fitted = trained
    scored = fitted.transform(FE.add_features(FC.forecast_frame(fx.prediction_requests(), sched, index)))
    lo_hi = sched.agg(F.min(K.START), F.max(K.START), F.min(K.END), F.max(K.END)).first()
    p = scored.agg(F.min("pred_start"), F.max("pred_start"), F.min("pred_end"), F.max("pred_end")).first()
    assert lo_hi[0] <= p[0] <= p[1] <= lo_hi[1]
    assert lo_hi[2] <= p[2] <= p[3] <= lo_hi[3]


def test_window_row_counts_and_rejects(spark, trained):
    fx, sched, index, fitted = trained
    req = spark.createDataFrame([(r.id, "25/01/2024", s) for r in index.limit(1).collect()
                                 for s in (31, 30, 1, 0, -1)] + [("nobody", "25/01/2024", 31),
                                                                 ("0", "31/02/2024", 31)],
                                "id string, target_date string, window_size int")
    out = FC.forecast(req, sched, fitted, index)
    counts = {r.window_size: r["count"] for r in out.groupBy("window_size").count().collect()}
    assert counts == {31: 31, 30: 31, 1: 1, 0: 1}
    rej = {r.id: r.reason for r in FC.request_rejects(req, index).collect()}
    assert rej == {"nobody": "unknown_id", "0": "invalid_date"}


def test_same_seed_same_forest_and_save_load(spark, trained, tmp_dir):
    fx, sched, index, fitted = trained
    again = M.fit_models(FE.training_frame(sched, index), SMALL_FOREST)
    frame = FE.add_features(FC.forecast_frame(fx.prediction_requests(), sched, index))

    def preds(m):
        return sorted((r.id, r.day, r.p1, r.p2) for r in m.transform(frame).select(
            K.ID, F.col(K.DATE).alias("day"), F.col("pred_start").alias("p1"),
            F.col("pred_end").alias("p2")).collect())

    first = preds(fitted)
    assert first == preds(again)
    summary = M.training_summary(sched, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), SMALL_FOREST)
    M.save_models(fitted, index, summary, tmp_dir + "/model")
    loaded, idx2, summ2 = M.load_models(spark, tmp_dir + "/model")
    assert preds(loaded) == first
    assert M.model_info(summ2)["entity_count"] == index.count()
    assert M.load_models(spark, tmp_dir + "/absent") is None


def test_beats_global_mean_on_weekday_pattern(spark):
    # Start time depends on the weekday only; the forest must learn it.
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(str(e), d, 420.0 + 30 * d.weekday(), 960.0 + 30 * d.weekday())
            for e in range(5) for d in days]
    sched = spark.createDataFrame(rows, "id string, date date, start_time_by_minutes double, "
                                        "end_time_by_minutes double")
    index = FE.id_index(sched)
    fitted = M.fit_models(FE.training_frame(sched, index), SMALL_FOREST)
    scored = fitted.transform(FE.training_frame(sched, index))
    mean = sched.agg(F.avg(K.START)).first()[0]
    err = scored.agg(F.avg(F.abs(F.col("pred_start") - F.col(K.START))),
                     F.avg(F.abs(F.lit(mean) - F.col(K.START)))).first()
    assert err[0] < err[1] / 5


def test_memory_of_a_pass_is_bounded_and_gives_the_same_forest(spark, trained):
    """A task holds a pass's statistics: 4 tasks of 256 MB and their shuffle fit an executor of 6 GB, 4 of 1 GB did not.
    Node ids are not cached, so no pass writes 100 numbers a row.  Passes of a few nodes grow the same trees."""
    fx, sched, index, fitted = trained
    for forest in fitted.stages[1:]:
        assert forest.getMaxMemoryInMB() <= 256 and not forest.getCacheNodeIds()
    few = M.ForestParams(num_trees=SMALL_FOREST.num_trees, max_depth=SMALL_FOREST.max_depth, max_memory_mb=1)
    again = M.fit_models(FE.training_frame(sched, index), few)
    assert [f.toDebugString.split("\n", 1)[1] for f in again.stages[1:]] == [f.toDebugString.split("\n", 1)[1] for f in fitted.stages[1:]]


def test_single_day(spark, trained):
    fx, sched, index, fitted = trained
    out = FC.forecast_single_day(fx.prediction_requests(), sched, fitted, index)
    assert out.count() == fx.prediction_requests().where("target_date IS NOT NULL").join(index, "id").count()


def test_ordered_output(spark, trained):
    fx, sched, index, fitted = trained
    rows = FC.ordered(FC.forecast_history(fx.prediction_requests(), sched, index)).collect()
    keys = [(r.id, r.target_date, r.window_size, r.day) for r in rows]
    assert keys == sorted(keys)


def test_entity_history_pushdown(spark, tmp_dir):
    from shiftspark.sources import store
    sched = Fixtures(spark, SF_SMALL).schedule()
    store.save_schedule(sched, tmp_dir + "/s")
    one = sched.select("id").first().id
    h = store.entity_history(store.read_schedule(spark, tmp_dir + "/s"), one)
    assert h.count() == sched.where(F.col("id") == one).count()
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in plan


def test_history_without_order_gives_one_row_per_day(spark, trained):
    fx, sched, index, fitted = trained
    doubled = sched.unionByName(sched.withColumn(K.END, F.col(K.END) + 1))
    a = FC.forecast_history(fx.prediction_requests(), sched, index).count()
    assert FC.forecast_history(fx.prediction_requests(), doubled, index).count() == a


def test_prediction_mask(spark):
    """Start < 0, end < 0 or end <= start -> both NA; otherwise clock text."""
    df = spark.createDataFrame([(480.4, 1020.6), (-1.0, 500.0), (500.0, -3.0), (600.0, 600.0),
                                (700.0, 650.0), (None, 500.0)], "s double, e double")
    s, e = FC.mask_prediction(F.col("s"), F.col("e"))
    got = [tuple(r) for r in df.select(s, e).collect()]
    assert got == [("08:00", "17:01"), ("NA", "NA"), ("NA", "NA"), ("NA", "NA"), ("NA", "NA"),
                   ("NA", "NA")]


def test_many_requested_days_are_not_broadcast(spark):
    """Few rows of requests are many days: the plan goes by the days, and both ways give the same rows."""
    sched = spark.createDataFrame([(str(i), dt.date(2024, 1, 1 + d), 480.0 + i, 960.0 + d) for i in range(40) for d in range(0, 28, 3)],
                                  "id string, date date, start_time_by_minutes double, end_time_by_minutes double")
    index = FE.id_index(sched)
    many = spark.range(1700).select(F.col("id").cast("string").alias("id"), F.lit("15/01/2024").alias("target_date"), F.lit(31).alias("window_size"))

    def plan(requests):
        return FC.forecast_history(requests, sched, index)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin [id" not in plan(many) and "BroadcastHashJoin [id" in plan(many.limit(50))
    rows = FC.forecast_history(many, sched, index)
    known = many.where("CAST(id AS INT) < 40")
    assert rows.count() == 40 * 31 and rows.where("historical").count() == sched.count()
    assert sorted(map(str, rows.collect())) == sorted(map(str, FC.forecast_history(known, sched, index).collect()))
    no_days = many.withColumn("target_date", F.lit(None).cast("string"))
    assert FC.forecast_history(no_days, sched, index).count() == 0


def frame_plans(monkeypatch):
    """Plans of the frames that a forecast writes."""
    plans, write = [], FC.write_and_read
    monkeypatch.setattr(FC, "write_and_read", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    return plans


def test_model_forecast_of_many_days_is_not_broadcast(spark, trained, monkeypatch):
    fx, sched, index, fitted = trained
    plans = frame_plans(monkeypatch)
    requests = spark.range(1700).select(F.col("id").cast("string").alias("id"), F.lit("25/01/2024").alias("target_date"), F.lit(31).alias("window_size"))
    out = FC.forecast(requests, sched, fitted, index)
    assert "BroadcastHashJoin [id" not in plans[0]
    assert out.count() == 31 * index.where("CAST(id AS INT) < 1700").count()


def test_single_days_of_many_requests_are_not_broadcast(spark, trained, monkeypatch):
    fx, sched, index, fitted = trained
    plans = frame_plans(monkeypatch)
    requests = spark.range(FC.FEW_DAYS + 1).select(F.col("id").cast("string").alias("id"), F.lit("25/01/2024").alias("target_date"), F.lit(31).alias("window_size"))
    out = FC.forecast_single_day(requests, sched, fitted, index)
    assert "BroadcastHashJoin [id" not in plans[0]
    assert out.count() == index.count()
