"""Plan properties the design relies on at scale (regression guards)."""

import __spark_entry__ as E

from conftest import SF_SMALL


def plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_session_views_prune_columns_and_do_not_shuffle(spark):
    p = plan(spark, "active_sessions")
    # Every order is a session, and its expiry a CASE over the shifted date: that filter cannot reach the scan.
    assert "LessThan(o_orderdate" not in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p
    assert "Exchange" not in p


def test_forecast_history_is_cut_to_the_calendar_span_before_aggregating(spark):
    p = plan(spark, "forecast_history")
    # The span filter (two scalar subqueries) sits below the schedule aggregation.
    assert p.count("Subquery subquery") >= 2
    agg_at = p.find("HashAggregate")
    assert "subquery" in p[agg_at:].lower()


def test_system_statistics_has_no_join(spark):
    p = plan(spark, "system_statistics")
    assert "Join" not in p and "CartesianProduct" not in p


def test_log_retention_trigger_stops_early(spark):
    p = plan(spark, "log_retention")
    assert "CollectLimit" in p and "HashAggregate" not in p


def test_small_threshold_tables_are_broadcast(spark):
    """Written threshold tables carry their real size: when small, the log is
    not shuffled to meet them."""
    p = plan(spark, "rate_rejects")
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_lifecycle_events_need_no_join(spark):
    p = plan(spark, "session_lifecycle_events")
    assert "Join" not in p and "Exchange" not in p


def test_usage_scans_the_log_once(spark):
    """Duplicate-training detection reads a written slice of training rows, not the log."""
    p = plan(spark, "usage_by_window")
    assert p.count("events.parquet") == 1


def test_ordered_forecast_of_many_days_is_not_broadcast(spark):
    """Places of a forecast whose requests are few rows but many days."""
    import datetime as dt

    from pyspark.sql import functions as F

    from shiftspark.operators import features, forecast
    from shiftspark.operators.places import with_place
    sched = spark.createDataFrame([(str(i), dt.date(2024, 1, 2), 480.0, 960.0) for i in range(5)],
                                  "id string, date date, start_time_by_minutes double, end_time_by_minutes double")
    requests = spark.range(1700).select(F.col("id").cast("string").alias("id"), F.lit("15/01/2024").alias("target_date"), F.lit(31).alias("window_size"))
    ordered = forecast.ordered(forecast.forecast_history(requests, sched, features.id_index(sched)))
    assert "BroadcastHashJoin [id" not in ordered._jdf.queryExecution().executedPlan().toString()
    assert [(r.place, r.id, r.day.day) for r in with_place(ordered).where("historical").orderBy("place").collect()] == [
        (31 * i + 3, str(i), 2) for i in range(5)]
