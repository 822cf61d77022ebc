"""Ordered folds against the same folds one event at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.operators import ordered

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def many_chunks(spark):
    """Small inputs keep all their range partitions, so folds cross chunks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot(r, ips=5):
    return "hot" if r.random() < 0.4 else f"10.0.0.{r.randrange(ips)}"


@pytest.mark.parametrize("seed", [1, 2])
def test_floored_counter(spark, many_chunks, seed):
    r = random.Random(seed)
    rows = [(hot(r), r.randrange(60), i, r.choice([1, -1, -1, 2, -3])) for i in range(600)] + [(None, 5, 1000, -1), (None, 6, 1001, 1)]
    df = spark.createDataFrame(rows, "ip string, at long, id long, d long")
    assert df.repartitionByRange("ip", "at", "id").select(F.spark_partition_id()).distinct().count() > 3
    got = {x.id: x.n for x in ordered.floored_counter(df, "ip", ["at", "id"], "d", "n").collect()}
    count, want = {}, {}
    for ip, _, i, d in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        want[i] = count[ip] = max(0, count.get(ip, 0) + d)
    assert got == want


def test_models_counter_with_early_deletions(spark, many_chunks):
    def s(i, ip, made, gone):
        return (f"s{i}", ip, T0 + dt.timedelta(days=made), T0 + dt.timedelta(days=gone))

    rows = [s(1, "a", 10, 9), s(2, "a", 11, 20), s(3, "a", 11, 11), s(4, None, 3, 2), s(5, "b", 1, 400), s(6, "b", 1, 1)]
    df = spark.createDataFrame(rows, "session_id string, ip_address string, created_at timestamp_ntz, expires_at timestamp_ntz")
    got = {(x.session_id, x.delta): (x.ip_address, x.models_count) for x in ordered.models_counter(df, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert got == {("s1", -1): ("a", 0), ("s1", 1): ("a", 1), ("s2", 1): ("a", 2), ("s3", 1): ("a", 3), ("s3", -1): ("a", 2), ("s2", -1): ("a", 1),
                   ("s4", -1): (K.UNKNOWN_IP, 0), ("s4", 1): (K.UNKNOWN_IP, 1), ("s5", 1): ("b", 1), ("s6", 1): ("b", 2), ("s6", -1): ("b", 1)}


def admit_one_by_one(rows, limit):
    used, fits = {}, {}
    for ip, at, i, size in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        fits[i] = used.get(ip, 0) + size <= limit
        used[ip] = used.get(ip, 0) + (size if fits[i] else 0)
    return fits


@pytest.mark.parametrize("seed,limit,sizes", [
    (1, 1000, [0, 1, 2, 5, 30, 100, 400, 999, 1000, 1001]), (2, 0, [0, 1]), (3, 1, [0, 1, 1, 2]), (4, 2**40, [0, 2**36, 2**39 + 1, 3, 2**40]),
    (5, 77, list(range(80)))])
def test_admission_under_a_limit(spark, many_chunks, seed, limit, sizes):
    r = random.Random(seed)
    rows = [(hot(r), r.randrange(50), i, r.choice(sizes)) for i in range(400)]
    df = spark.createDataFrame([(ip, T0 + dt.timedelta(minutes=at), i, size) for ip, at, i, size in rows],
                               "ip_address string, created_at timestamp_ntz, id long, size long")
    assert {x.id: x.fits for x in ordered.admit(df, limit).collect()} == admit_one_by_one(rows, limit)


def decide_one_by_one(events, limits):
    state, out = {}, {}
    mb = 1024 * 1024
    for kind, i, ip, at, size in sorted(events, key=lambda e: (e[2] or K.UNKNOWN_IP, e[3], e[1])):
        s = state.setdefault(ip or K.UNKNOWN_IP, {"used": 0, "models": 0, "wrong": 0, "until": None, "banned": False})
        size = max(0, size or 0)
        if s["until"] and at < s["until"]:
            out[i] = "banned"
            continue
        if kind == "upload" and size > limits["max_file_size_mb"] * mb:
            out[i] = "too_large"
        elif kind == "upload" and s["used"] + 3 * size > limits["max_storage_per_ip_mb"] * mb:
            out[i] = "storage"
        elif kind == "session" and s["models"] >= limits["models_per_ip"]:
            out[i] = "models"
        else:
            out[i] = "accepted"
            s["used"] += 3 * size if kind == "upload" else 0
            s["models"] += kind == "session"
        if out[i] in ("storage", "models"):
            s["wrong"] += 1
            if s["wrong"] >= limits["ban_after_violations"] and not s["banned"]:
                s["banned"], s["until"] = True, at + dt.timedelta(hours=limits["ban_duration_hours"])
    return out, state


SCHEMA = "kind string, id long, ip_address string, created_at timestamp_ntz, size long"


@pytest.mark.parametrize("seed,change", [
    (1, {}), (2, {"models_per_ip": 0, "ban_after_violations": 1}), (3, {"max_storage_per_ip_mb": 0, "ban_duration_hours": 1})])
def test_quota_admission(spark, many_chunks, seed, change):
    r = random.Random(seed)
    limits = K.DEFAULT_QUOTAS | {"models_per_ip": 3, "max_storage_per_ip_mb": 90, "ban_after_violations": 4, "ban_duration_hours": 30} | change
    mb = 1024 * 1024
    events = [(r.choice(["session", "upload", "upload"]), i, None if i % 17 == 0 else hot(r), T0 + dt.timedelta(hours=r.randrange(150)),
               r.choice([None, 0, -5, mb, 5 * mb, 9 * mb + 1, 20 * mb, 60 * mb])) for i in range(350)]
    got = ordered.quota_admission(spark.createDataFrame(events, SCHEMA), limits)
    want, state = decide_one_by_one(events, limits)
    assert {x.id: x.outcome for x in got.collect()} == want and {"banned", "models"} <= set(want.values())
    per_ip = {x.ip_address: x for x in ordered.admission_per_ip(got, limits).collect()}
    assert {ip: (x.violations, x.storage_mb) for ip, x in per_ip.items()} == {ip: (s["wrong"], s["used"] / mb) for ip, s in state.items()}
    assert {ip: x.banned_until for ip, x in per_ip.items()} == {ip: s["until"] for ip, s in state.items()}


def test_quota_admission_of_nothing(spark):
    assert ordered.quota_admission(spark.createDataFrame([], SCHEMA)).collect() == []
