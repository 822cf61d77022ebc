"""The audit log by day: appends, clean-up of whole days, the border's day."""

import datetime as dt

from pyspark.sql import functions as F

from shiftspark.operators import quality
from shiftspark.sources import audit_store as S
from shiftspark.sources.store import AUDIT_SCHEMA

NOON = dt.datetime(2024, 1, 31, 12)


def now():
    return F.lit(NOON).cast("timestamp_ntz")


def log(spark, times, first=0):
    rows = [(first + i, f"s{i}", "10.0.0.1", "e", "{}", "INFO", t) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def hours(spark, n=400):
    return log(spark, [NOON - dt.timedelta(hours=i) for i in range(n)] + [None, None])


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def files(spark, path):
    rows = S.read_by_day(spark, path).select(S.DAY, F.col("_metadata.file_path").alias("f")).distinct().collect()
    return {r.f for r in rows if r.day and r.day > dt.date(2024, 1, 24)}


def test_clean_up_equals_the_filter_and_leaves_later_days_alone(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    rows = hours(spark)
    S.append_by_day(rows.where("id % 3 = 0"), path)
    S.append_by_day(rows.where("id % 3 != 0"), path)
    assert ids(S.read_by_day(spark, path)) == ids(rows)
    before = files(spark, path)
    gone, rewritten = S.clean_by_day(spark, path, now(), keep_days=7, trigger_rows=401)
    assert rewritten == dt.date(2024, 1, 24) and gone[0] is None and gone[-1] == dt.date(2024, 1, 23)
    assert ids(S.read_by_day(spark, path)) == ids(quality.log_retention(rows, now(), 7, 401)) == list(range(7 * 24 + 1))
    assert files(spark, path) == before and len(before) > 6
    # Once more: nothing is left to drop.
    again, _ = S.clean_by_day(spark, path, now(), keep_days=7, trigger_rows=10)
    assert again == [] and S.read_by_day(spark, path).count() == 169
    S.append_by_day(log(spark, [NOON], first=900), path)
    assert S.read_by_day(spark, path).count() == 170


def test_a_log_below_the_trigger_stays(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    S.append_by_day(hours(spark, 50), path)
    assert S.clean_by_day(spark, path, now(), keep_days=1, trigger_rows=52) == ([], None)
    assert S.read_by_day(spark, path).count() == 52


def test_borders_at_midnight_and_days_without_rows_that_stay(spark, tmp_dir):
    a, b = f"{tmp_dir}/a", f"{tmp_dir}/b"
    S.append_by_day(hours(spark, 100), a)
    midnight = F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")
    gone, rewritten = S.clean_by_day(spark, a, midnight, keep_days=1, trigger_rows=0)
    assert rewritten is None and dt.date(2024, 1, 30) not in gone and S.read_by_day(spark, a).count() == 37
    # All of the border's day lies before the border.
    S.append_by_day(log(spark, [dt.datetime(2024, 1, 30, 8), dt.datetime(2024, 1, 30, 11, 59, 59), dt.datetime(2024, 1, 31, 1)]), b)
    assert S.clean_by_day(spark, b, now(), keep_days=1, trigger_rows=0) == ([dt.date(2024, 1, 30)], None)
    assert ids(S.read_by_day(spark, b)) == [2]


def test_the_clean_up_reads_one_day_and_counts_without_columns(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    S.append_by_day(hours(spark), path)
    rows = S.border_rows(spark, path, NOON - dt.timedelta(days=7))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day=2024-01-24" not in plan
    assert rows.select("_metadata.file_path").distinct().count() <= 8
    assert {r.day for r in rows.select("day").distinct().collect()} == {dt.date(2024, 1, 24)}
    count = S.read_by_day(spark, path).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in count


def test_rows_without_an_id_get_one(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    S.append_by_day(log(spark, [NOON, NOON]).withColumn("id", F.lit(None).cast("long")), path)
    got = ids(S.read_by_day(spark, path))
    assert None not in got and len(set(got)) == 2
