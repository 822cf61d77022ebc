"""Audit views, lookups and quality checks not covered by the oracle sweep."""

import datetime as dt

from pyspark.sql import functions as F

from shiftspark.functions import timeparts as T
from shiftspark.operators import audit as A
from shiftspark.operators import quality as QL
from shiftspark.sources.tables import Fixtures

from conftest import SF_SMALL


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def test_views_sort_when_asked(spark):
    fx = Fixtures(spark, SF_SMALL)
    act = [r.last_accessed for r in A.active_sessions(fx.sessions(), now(), ordered=True).collect()]
    assert act == sorted(act, reverse=True)
    exp = [r.expires_at for r in A.expired_sessions(fx.sessions(), now(), ordered=True).collect()]
    assert exp == sorted(exp, reverse=True)
    ev = [r.created_at for r in A.recent_security_events(fx.security_logs(), now(), ordered=True).collect()]
    assert ev == sorted(ev, reverse=True)
    sus = [r.violations_count for r in A.suspicious_ips(fx.ip_quotas(), now(), ordered=True).collect()]
    assert sus == sorted(sus, reverse=True)


def test_banned_without_end_differs_between_rules(spark):
    q = spark.createDataFrame(
        [("a", True, None, 1), ("b", True, dt.datetime(2030, 1, 1), 1), ("c", False, None, 7)],
        "ip_address string, is_banned boolean, banned_until timestamp_ntz, violations_count long")
    orm = {r.ip_address: r.b for r in q.select("ip_address", A.currently_banned(now()).alias("b")).collect()}
    view = {r.ip_address: r.s for r in q.select(
        "ip_address", T.ip_status("is_banned", "banned_until", "violations_count", now()).alias("s")).collect()}
    assert orm == {"a": True, "b": True, "c": False}
    assert view == {"a": "NORMAL", "b": "BANNED", "c": "WARNING"}


def test_lookups(spark):
    fx = Fixtures(spark, SF_SMALL)
    s = fx.sessions()
    one = s.select("session_id", "ip_address").first()
    assert A.first_session(s, one.session_id).count() == 1
    assert A.first_session(s, "missing").count() == 0
    keys = spark.createDataFrame([(one.session_id,), ("missing",)], "session_id string")
    assert A.lookup_sessions(s, keys).count() == 1
    ips = spark.createDataFrame([(one.ip_address,)], "ip_address string")
    got = A.sessions_of_ip(s, ips, now())
    assert {r.ip_address for r in got.collect()} <= {one.ip_address}
    assert got.count() == s.where((F.col("ip_address") == one.ip_address) & (F.col("expires_at") > now())).count()


def test_small_helpers(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "x int")
    assert [r[0] for r in df.select(T.floor_zero_decrement("x")).collect()] == [0, 0, 4]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert ts.select(T.expiry_from_creation("t")).first()[0] == dt.datetime(2024, 12, 31)
    assert ts.select(T.bytes_to_mb(F.lit(3 * 1048576))).first()[0] == 3.0


def test_session_reject_reasons(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("f" * 64, "ip", t, t + dt.timedelta(days=1), '{"a":1}'),
            ("xyz", "ip", t, t + dt.timedelta(days=1), None),
            ("a" * 64, "ip", t, t, None),
            ("b" * 64, "ip", t, t + dt.timedelta(days=1), "{'a': 1}")]
    s = spark.createDataFrame(rows, "session_id string, ip_address string, created_at timestamp_ntz, "
                                    "expires_at timestamp_ntz, metadata string")
    got = {r.session_id[:3]: r.reason for r in QL.session_rejects(s).collect()}
    assert got == {"xyz": "bad_token", "aaa": "expiry_not_in_future", "bbb": "invalid_metadata_json"}
    assert QL.valid_sessions(s).count() == 1


def test_profile_with_size(spark):
    sched = Fixtures(spark, SF_SMALL).schedule()
    r = QL.dataset_profile(sched, F.lit(60.0)).first()
    assert r.data_points == sched.count() and r.within_max_data_points
    assert r.size_mb == 60.0 and not r.within_max_file_size


def test_retention_trigger(spark):
    logs = Fixtures(spark, SF_SMALL).security_logs()
    n = logs.count()
    # Over the trigger: rows older than the window are dropped.
    assert QL.log_retention(logs, now(), keep_days=10, trigger_rows=n - 1).count() < n
    # Not over it: nothing is dropped.
    assert QL.log_retention(logs, now(), keep_days=10, trigger_rows=n).count() == n


def test_cascade_removes_the_deletion_event_too(spark):
    """Q19: with cascade, the session_deleted row written for a removed
    session disappears with its other log rows; without cascade it stays."""
    fx = Fixtures(spark, SF_SMALL)
    s = fx.sessions()
    t1 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    before, after = A.session_snapshot(s, t1), A.session_snapshot(s, now())
    events = A.lifecycle_events(before, after, now()).withColumn("id", F.lit(None).cast("long"))
    log = fx.security_logs().unionByName(events.select(*fx.security_logs().columns))
    doomed = events.where(F.col("event_type") == "session_deleted").select("session_id")
    assert doomed.count() > 0
    _, kept = A.delete_sessions(before, log, doomed, cascade=True)
    assert kept.where(F.col("event_type") == "session_deleted").count() == 0
    _, kept_all = A.delete_sessions(before, log, doomed, cascade=False)
    assert kept_all.where(F.col("event_type") == "session_deleted").count() == doomed.count()


def test_lifecycle_single_scan_equals_snapshot_join(spark):
    s = Fixtures(spark, SF_SMALL).sessions()
    t1 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    a = A.lifecycle_events(A.session_snapshot(s, t1), A.session_snapshot(s, now()), now())
    b = A.lifecycle_events_between(s, t1, now())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert "Join" not in b._jdf.queryExecution().executedPlan().toString()
