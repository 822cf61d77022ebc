"""End-to-end jobs: train from a CSV upload, serve requests, clean up, session info."""

import pytest
from pyspark.sql import functions as F

from shiftspark.operators import model as M
from shiftspark.plans import jobs
from shiftspark.plans.catalog import raw_upload
from shiftspark.sources import store
from shiftspark.sources.tables import Fixtures

from conftest import SF_SMALL


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def test_train_then_serve(spark, tmp_dir):
    fx = Fixtures(spark, SF_SMALL)
    up = f"{tmp_dir}/upload"
    raw_upload(fx.table("events")).coalesce(1).write.option("header", True).csv(up)
    res = jobs.train(spark, up, "ds1", f"{tmp_dir}/sched", f"{tmp_dir}/models", now(),
                     params=M.ForestParams(num_trees=3, max_depth=5),
                     audit_path=f"{tmp_dir}/audit", ip_address="10.0.0.1")
    assert res.summary["is_trained"] and res.summary["data_row_count"] > 0
    prof = res.profile
    assert prof["data_points"] == res.summary["data_row_count"]
    assert 0 < prof["size_mb"] < 50 and prof["within_max_file_size"]
    out, rejects = jobs.serve(spark, fx.prediction_requests(), "ds1", f"{tmp_dir}/sched",
                              f"{tmp_dir}/models")
    assert out.count() > 0 and rejects.count() > 0
    assert out.where(F.col("start_time").isNull()).count() == 0
    log = store.read_audit_log(spark, f"{tmp_dir}/audit").collect()
    assert [r.event_type for r in log] == ["model_trained"]
    with pytest.raises(LookupError):
        jobs.serve(spark, fx.prediction_requests(), "nope", f"{tmp_dir}/sched", f"{tmp_dir}/models")
    info = jobs.session_info(
        fx.sessions().limit(3).withColumn("session_id", F.lit("ds1")).limit(1),
        spark.read.json(f"{res.model_path}/summary").withColumn("dataset_id", F.lit("ds1")), now())
    assert info.first().is_trained


def test_cleanup_cascade(spark, tmp_dir):
    fx = Fixtures(spark, SF_SMALL)
    s, logs = fx.sessions(), fx.security_logs()
    kept_s, kept_l = jobs.cleanup(s, logs, now(), cascade=True,
                                  sessions_out=f"{tmp_dir}/s", logs_out=f"{tmp_dir}/l")
    expired = s.where(F.col("expires_at") <= now()).select("session_id")
    assert kept_s.join(expired, "session_id").count() == 0
    assert spark.read.parquet(f"{tmp_dir}/l").join(expired, "session_id").count() == 0
    _, all_logs = jobs.cleanup(s, logs, now(), cascade=False)
    assert all_logs.count() == logs.count()
