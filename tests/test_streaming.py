"""Batch = stream (T1, T4) for closed windows."""

import datetime as dt

from pyspark.sql import functions as F

from shiftspark.operators import quotas as Q
from shiftspark.sources.tables import Fixtures
from shiftspark.streaming import usage as S

from conftest import SF_SMALL


def test_stream_usage_equals_batch_for_closed_windows(spark):
    logs = Fixtures(spark, SF_SMALL).security_logs()
    wm = logs.agg(F.max("created_at")).first()[0]
    import datetime as dt
    # The stream takes the log as it is: a training logged twice counts twice (README).
    batch = Q.usage_by_window(logs, "1 hour", dedup_trainings=False).where(F.col("window_end") <= F.lit(wm - dt.timedelta(minutes=10)))
    stream = S.run_to_table(S.usage_stream(S.log_stream(spark, SF_SMALL), "1 hour"), "t-usage")
    key = ["ip_address", "window_start", "window_end", "requests", "trainings", "predictions"]
    assert sorted(tuple(r) for r in batch.select(*key).collect()) == \
        sorted(tuple(r) for r in stream.select(*key).collect())


def test_stream_static_ip_changes_equal_batch(spark):
    fx = Fixtures(spark, SF_SMALL)
    batch = Q.ip_changes(fx.security_logs(), fx.sessions())
    stream = S.run_to_table(Q.ip_changes(S.log_stream(spark, SF_SMALL), fx.sessions()), "t-ipc")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_stream_windows_do_not_depend_on_session_zone(spark):
    logs = Fixtures(spark, SF_SMALL).security_logs()
    key = ["ip_address", "window_start", "window_end", "requests"]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        stream = S.run_to_table(S.usage_stream(S.log_stream(spark, SF_SMALL), "1 day"), "t-tz")
        got = sorted(tuple(r) for r in stream.select(*key).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    batch = Q.usage_by_window(logs, "1 day", dedup_trainings=False)
    closed = {tuple(r) for r in batch.select(*key).collect()}
    assert got and set(got) <= closed
    assert all(r[1].hour == 0 for r in got)


def test_stream_bans_carry_state_across_micro_batches(spark, tmp_dir):
    """Events split over several files, one file per trigger: the state carried
    between micro-batches must give the row-by-row answer."""
    import os
    import random

    import pandas as pd

    from shiftspark.streaming import bans as SB
    from test_quotas import simulate

    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    events = sorted(({"id": i, "ip_address": f"ip{rnd.randrange(3)}",
                      "event_type": rnd.choice(["prediction_made", "model_trained", "session_accessed"]),
                      "created_at": base + dt.timedelta(seconds=rnd.randrange(0, 2 * 86400)),
                      "session_id": None} for i in range(900)),
                    key=lambda e: (e["created_at"], e["id"]))
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    for part in range(6):
        chunk = pd.DataFrame(events[part * 150:(part + 1) * 150]).drop(columns=["session_id"])
        path = os.path.join(src, f"part-{part}.parquet")
        chunk.to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    schema = "id long, ip_address string, event_type string, created_at timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    limits = (Q.RateLimit("request", "1 hour", 8), Q.RateLimit("p", "1 hour", 3, ("prediction_made",)))
    decisions = S.run_to_table(SB.ban_decisions(stream, limits, after=12, hours=5), "t-bans")
    got = {r.ip_address: r for r in SB.bans_from_decisions(decisions, 12, 5).collect()}
    acc, vio, ref, ban, _ = simulate(events, limits, after=12, hours=5)
    assert set(got) == set(acc) | set(vio) | set(ref)
    for ip, r in got.items():
        assert (r.accepted, r.violations, r.refused_while_banned) == (acc[ip], vio[ip], ref[ip])
        assert r.banned_at == (ban[ip][0] if ip in ban else None)
    assert any(ip in ban for ip in got)


def test_deployed_stream_resumes_from_its_checkpoint(spark, tmp_dir):
    """A long-running deployment: stop it, start again on the same checkpoint,
    nothing is counted twice."""
    fx = Fixtures(spark, SF_SMALL)
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"
    for _ in range(2):
        q = S.start_to_parquet(Q.ip_changes(S.log_stream(spark, SF_SMALL), fx.sessions()),
                               out, ck, "1 second")
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(out)
    assert got.count() == Q.ip_changes(fx.security_logs(), fx.sessions()).count()


def test_events_behind_the_watermark_are_dropped(spark, tmp_dir):
    """A row arriving after its window was closed and emitted is not counted.
    (Spark filters late rows with the watermark of the previous micro-batch, so
    the late row comes two batches after the one that moved the watermark.)"""
    import os

    import pandas as pd

    src = os.path.join(tmp_dir, "logs")
    os.makedirs(src)
    t = dt.datetime(2024, 1, 1)
    files = [[(1, "a", "model_trained", t + dt.timedelta(hours=9, minutes=5)),
              (2, "a", "session_accessed", t + dt.timedelta(hours=12))],
             [(3, "a", "session_accessed", t + dt.timedelta(hours=14))],
             [(4, "a", "session_accessed", t + dt.timedelta(hours=9, minutes=30)),   # late
              (5, "a", "session_accessed", t + dt.timedelta(hours=16))]]
    for i, rows in enumerate(files):
        df = pd.DataFrame(rows, columns=["id", "ip_address", "event_type", "created_at"])
        path = os.path.join(src, f"part-{i}.parquet")
        df.to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "id long, ip_address string, event_type string, created_at timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_to_table(S.usage_stream(stream, "1 hour"), "t-late")
    got = sorted((r.window_start.hour, r.requests, r.trainings) for r in out.collect())
    # 09:00 keeps only its on-time row and is emitted once; 16:00 stays open.
    assert got == [(9, 1, 1), (12, 1, 0), (14, 1, 0)]


def test_registered_streams_do_not_depend_on_the_order_of_files(spark, tmp_dir):
    """20 part files not in time order: windows and bans are those of the single file."""
    from shiftspark.plans.catalog import REGISTRY
    from shiftspark.sources.tables import read_table

    read_table(spark, SF_SMALL, "events").repartition(20, F.rand(3)).write.parquet(f"{tmp_dir}/events.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    usage = rows(S.q_stream_usage_by_window(spark, tmp_dir))
    assert usage and usage == rows(S.q_stream_usage_by_window(spark, SF_SMALL))
    bans = rows(S.q_stream_bans(spark, tmp_dir))
    assert bans and bans == rows(S.q_stream_bans(spark, SF_SMALL))


def test_an_ip_is_decided_in_chunks_as_in_one_piece():
    import random

    import pandas as pd

    from shiftspark.streaming import bans as SB

    class State:
        exists = False

        def update(self, x):
            self.get = x

    r = random.Random(5)
    rows = pd.DataFrame([(i, r.choice(["prediction_made", "model_trained"]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(90_000)))
                         for i in range(1000)], columns=["id", "event_type", "created_at"])
    limits = (Q.RateLimit("request", "1 hour", 30), Q.RateLimit("p", "1 hour", 12, ("prediction_made",)))
    got, states = [], []
    old = SB.CHUNK
    try:
        for SB.CHUNK in (10_000, 7):
            state = State()
            frames = list(SB._decider(limits, 40, 5)(("ip",), iter([rows[:600], rows[600:]]), state))
            assert max(map(len, frames)) <= SB.CHUNK
            got.append(pd.concat(frames, ignore_index=True))
            states.append(state.get)
    finally:
        SB.CHUNK = old
    pd.testing.assert_frame_equal(*got)
    assert states[0] == states[1] and set(got[0]["outcome"]) == {"accepted", "rejected", "refused"}
