"""Rate limits and bans (R1, R3) against a row-by-row simulation of the policy."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shiftspark.operators import quotas as Q
from shiftspark.sources.tables import Fixtures

from conftest import SF_SMALL

EPOCH = dt.datetime(1970, 1, 1)
UNIT = {"minute": 60, "hour": 3600, "day": 86400}


def window_start(ts, window):
    n, unit = window.split()
    size = int(n) * UNIT[unit.rstrip("s")]
    sec = int((ts - EPOCH).total_seconds())
    return sec - sec % size


def simulate(events, limits, after, hours):
    """The service's sequential decision, one event at a time."""
    counters = defaultdict(int)
    violations = defaultdict(int)
    accepted = defaultdict(int)
    refused = defaultdict(int)
    ban = {}
    rejects = {}
    for e in sorted(events, key=lambda e: (e["created_at"], e["id"])):
        ip, ts = e["ip_address"], e["created_at"]
        if ip in ban and ts < ban[ip][1] and (ts, e["id"]) > ban[ip][2]:
            refused[ip] += 1
            continue
        refused_by = None
        for lim in limits:
            if lim.event_types is not None and e["event_type"] not in lim.event_types:
                continue
            key = (ip, lim.action, window_start(ts, lim.window))
            if counters[key] >= lim.limit:
                refused_by = lim.action
                break
            counters[key] += 1
        if refused_by is None:
            accepted[ip] += 1
            continue
        rejects[e["id"]] = refused_by
        violations[ip] += 1
        if violations[ip] >= after and ip not in ban:
            ban[ip] = (ts, ts + dt.timedelta(hours=hours), (ts, e["id"]))
    return accepted, violations, refused, ban, rejects


def random_log(seed, n=600):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        out.append({"id": i, "ip_address": f"ip{rnd.randrange(4)}",
                    "event_type": rnd.choice(["prediction_made", "model_trained", "session_accessed"]),
                    "created_at": base + dt.timedelta(seconds=rnd.randrange(0, 3 * 86400)),
                    "session_id": None})
    return out


LIMITS = (Q.RateLimit("request", "1 hour", 6),
          Q.RateLimit("train", "1 day", 3, ("model_trained",)),
          Q.RateLimit("predict", "1 hour", 2, ("prediction_made",)))


def as_df(spark, events):
    return spark.createDataFrame(
        [(e["id"], e["ip_address"], e["event_type"], e["created_at"], e["session_id"]) for e in events],
        "id long, ip_address string, event_type string, created_at timestamp_ntz, session_id string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rejects_and_bans_match_simulation(spark, seed):
    events = random_log(seed)
    df = as_df(spark, events)
    # Without bans (threshold never reached) rejects equal the plain simulation.
    _, _, _, _, rejects = simulate(events, LIMITS, after=10**9, hours=24)
    got = {r.id: r.action for r in Q.rate_rejects(df, LIMITS).collect()}
    assert got == rejects
    acc, vio, ref, ban, _ = simulate(events, LIMITS, after=5, hours=6)
    for r in Q.bans(df, LIMITS, after=5, hours=6).collect():
        ip = r.ip_address
        assert (r.accepted, r.violations, r.refused_while_banned) == (acc[ip], vio[ip], ref[ip])
        assert r.is_banned == (ip in ban)
        if ip in ban:
            assert (r.banned_at, r.banned_until) == ban[ip][:2]


def test_fixture_log_matches_simulation(spark):
    logs = Fixtures(spark, SF_SMALL).security_logs()
    events = [r.asDict() for r in logs.select("id", "ip_address", "event_type", "created_at",
                                              "session_id").collect()]
    limits = (Q.RateLimit("request", "1 day", 3),)
    acc, vio, ref, ban, _ = simulate(events, limits, after=6, hours=24)
    got = {r.ip_address: r for r in Q.bans(logs, limits, after=6, hours=24).collect()}
    assert set(got) == set(acc) | set(vio) | set(ref)
    for ip, r in got.items():
        assert (r.accepted, r.violations, r.refused_while_banned) == (acc[ip], vio[ip], ref[ip])
        assert r.banned_until == (ban[ip][1] if ip in ban else None)


def test_group_limit_is_map_side(spark):
    """The per-window threshold uses Spark's partial per-group limit before the shuffle."""
    logs = Fixtures(spark, SF_SMALL).security_logs()
    thr = Q.stage_thresholds(logs, (Q.RateLimit("request", "1 day", 3),), materialize=False)[0]
    plan = thr._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lazy_and_materialized_agree(spark):
    logs = Fixtures(spark, SF_SMALL).security_logs()
    lims = (Q.RateLimit("request", "1 day", 3), Q.RateLimit("p", "1 hour", 1, ("prediction_made",)))
    a = sorted(map(tuple, Q.bans(logs, lims, 4, 24, materialize=False).collect()))
    b = sorted(map(tuple, Q.bans(logs, lims, 4, 24, materialize=True).collect()))
    assert a == b


def test_unban_and_defaults(spark):
    fx = Fixtures(spark, SF_SMALL)
    q = fx.ip_quotas()
    un = Q.unban(q, q.select("ip_address"))
    assert un.where(F.col("is_banned") | (F.col("violations_count") > 0)).count() == 0
    full = Q.default_quotas(q, fx.sessions(), fx.now())
    assert full.count() == q.count() + fx.sessions().select("ip_address").distinct() \
        .join(q, "ip_address", "left_anti").count()


def test_training_logged_twice_counts_once(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 59)
    rows = [(1, "s1", "ip", "model_trained", '{"entity_count": 3, "data_row_count": 40}', t),
            (2, "s1", "ip", "model_trained", "entities=3, data_points=40", t + dt.timedelta(seconds=2)),
            (3, "s1", "ip", "model_trained", '{"entity_count": 3, "data_row_count": 41}', t),
            (4, "s2", "ip", "model_trained", "entities=5, data_points=9", t),
            (5, "s1", "ip", "prediction_made", "entity_id=1, date=01/01/2024", t)]
    logs = spark.createDataFrame(rows, "id long, session_id string, ip_address string, event_type string, "
                                       "event_data string, created_at timestamp_ntz")
    kept = sorted(r.id for r in Q.without_duplicate_trainings(logs).collect())
    assert kept == [2, 3, 4, 5]
    u = Q.usage_by_window(logs, "1 day").first()
    assert (u.requests, u.trainings, u.predictions) == (4, 3, 1)


def test_hot_ip_with_skew_join_splitting(spark):
    """One ip holds a third of the log; joins are forced to sort-merge and AQE
    splits the skewed partitions.  Results still equal the simulation."""
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    events = []
    for i in range(3000):
        ip = "hot" if i % 3 == 0 else f"ip{rnd.randrange(40)}"
        events.append({"id": i, "ip_address": ip,
                       "event_type": rnd.choice(["prediction_made", "model_trained", "session_accessed"]),
                       "created_at": base + dt.timedelta(seconds=rnd.randrange(0, 2 * 86400)),
                       "session_id": None})
    df = as_df(spark, events).repartition(6)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        limits = (Q.RateLimit("request", "1 hour", 20), Q.RateLimit("p", "1 hour", 5, ("prediction_made",)))
        got = {r.id: r.action for r in Q.rate_rejects(df, limits).collect()}
        _, _, _, _, rejects = simulate(events, limits, after=10**9, hours=24)
        assert got == rejects and len(got) > 100
        acc, vio, ref, ban, _ = simulate(events, limits, after=30, hours=3)
        out = {r.ip_address: r for r in Q.bans(df, limits, after=30, hours=3).collect()}
        assert out["hot"].is_banned
        for ip, r in out.items():
            assert (r.accepted, r.violations, r.refused_while_banned) == (acc[ip], vio[ip], ref[ip])
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [3, 4])
def test_duplicate_trainings_match_brute_force(spark, seed):
    """Dense trainings with equal counts: the bucket probe equals a pairwise check."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = []
    for i in range(400):
        sess = f"s{rnd.randrange(3)}"
        ent, pts = rnd.choice([(3, 40), (3, 41)])
        t = base + dt.timedelta(microseconds=rnd.randrange(0, 300_000_000))
        data = (f'{{"entity_count": {ent}, "data_row_count": {pts}}}' if rnd.random() < 0.5
                else f"entities={ent}, data_points={pts}")
        rows.append((i, sess, "ip", "model_trained", data, t))
    logs = spark.createDataFrame(rows, "id long, session_id string, ip_address string, "
                                       "event_type string, event_data string, created_at timestamp_ntz")

    def counts(d):
        return tuple(int(x) for x in __import__("re").findall(r"[0-9]+", d))

    text = [(r[1], counts(r[4]), r[5]) for r in rows if r[4].startswith("entities=")]
    expect = sorted(r[0] for r in rows if not r[4].startswith("entities=") and any(
        s == r[1] and c == counts(r[4]) and r[5] <= tt <= r[5] + dt.timedelta(seconds=60)
        for s, c, tt in text))
    got = sorted(r.id for r in Q.duplicate_trainings(logs).collect())
    n_json = sum(1 for r in rows if not r[4].startswith("entities="))
    assert got == expect and 0 < len(got) < n_json


def test_limits_above_the_default_group_limit_threshold(spark):
    """A limit of 1100 (Spark's map-side limit stops at 1000 by default): the
    threshold is still computed with it, and results equal the simulation."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key, None)
    base = dt.datetime(2024, 1, 1)
    events = [{"id": i, "ip_address": "hot", "event_type": "session_accessed",
               "created_at": base + dt.timedelta(seconds=(i * 7919) % 80000), "session_id": None}
              for i in range(2500)]
    logs = as_df(spark, events).repartition(4)
    lim = (Q.RateLimit("request", "1 day", 1100),)
    with Q.group_limit_threshold(spark, 1100):
        thr = Q.stage_thresholds(logs, lim, materialize=False)[0]
        thr_plan = thr._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in thr_plan
    assert spark.conf.get(key, None) == before
    _, _, _, _, rejects = simulate(events, lim, after=10**9, hours=24)
    got = {r.id: r.action for r in Q.rate_rejects(logs, lim).collect()}
    assert got == rejects and len(got) == 1400


def test_empty_inputs(spark):
    """No over-limit group, or no log at all: empty written tables, empty answers."""
    from shiftspark.operators import features as FE
    logs = Fixtures(spark, SF_SMALL).security_logs()
    none = (Q.RateLimit("r", "1 day", 10**6),)
    assert Q.rate_rejects(logs, none).count() == 0
    assert Q.bans(logs, none, 3, 24).where("is_banned").count() == 0
    empty = logs.limit(0)
    assert Q.rate_rejects(empty, (Q.RateLimit("r", "1 day", 2),)).count() == 0
    assert Q.bans(empty, (Q.RateLimit("r", "1 day", 2),), 3, 24).count() == 0
    assert FE.id_index(spark.createDataFrame([], "id string")).count() == 0
