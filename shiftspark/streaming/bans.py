"""Rate limits and bans decided on the stream, one ip at a time.

``applyInPandasWithState`` keyed by ip keeps, per ip, the current window and
count of every limit, the violation count and the ban.  Within a micro-batch
an ip's events are taken in (created_at, id) order and decided with array
operations (window ranks by ``cumcount``, the ban point by a running sum),
so with in-order input the decisions equal the exact batch answer of
``operators.quotas.bans``.
State per ip is a handful of numbers.  Of an ip's rows in a micro-batch only
time, id and the limits that apply are held (24 bytes a row), to sort them; they
are decided and returned ``CHUNK`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftspark import constants as K
from shiftspark.functions.timeparts import plus_hours
from shiftspark.operators.quotas import RateLimit, known_ips

#: Rows of one ip that are decided together.
CHUNK = 100_000

_UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000,
            "day": 86_400_000_000}

DECISIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("outcome", T.StringType()),      # accepted / rejected / refused
    T.StructField("action", T.StringType()),       # the limit that rejected it
    T.StructField("violation_no", T.LongType()),   # running violation count of the ip
])


def duration_us(text: str) -> int:
    n, unit = text.split()
    return int(n) * _UNIT_US[unit.rstrip("s")]


def _state_schema(n_limits: int) -> T.StructType:
    fields = []
    for i in range(n_limits):
        fields += [T.StructField(f"w{i}", T.LongType()), T.StructField(f"c{i}", T.LongType())]
    fields += [T.StructField(n, T.LongType()) for n in ("violations", "ban_at", "ban_id", "ban_until")]
    return T.StructType(fields)


def _stages(ts, applies, live, win, cnt, sizes, caps):
    """Vectorised limit checks for one ip's rows (in time order).

    Returns the index of the limit refusing each row (-1 if none) and, per
    limit, the rows it counted.  A row counts for limit k when it reaches k
    (live, applicable, passed the earlier limits) and is under the cap; the
    count carried from the state applies while the window is unchanged.
    """
    n = len(ts)
    refused_by = np.full(n, -1)
    passed = live.copy()
    counted = []
    for k in range(len(sizes)):
        app = passed & (applies >> k & 1 == 1)
        w = ts - ts % sizes[k]
        before = np.zeros(n, dtype=np.int64)
        if app.any():
            wa = w[app]
            before[app] = pd.Series(wa).groupby(wa).cumcount().to_numpy()
            before[app] += np.where(wa == win[k], cnt[k], 0)
        rej = app & (before >= caps[k])
        refused_by[rej] = k
        counted.append((app & ~rej, w))
        passed = passed & ~rej
    return refused_by, counted


def _decider(limits: tuple[RateLimit, ...], after: int, hours: int):
    sizes = [duration_us(lim.window) for lim in limits]
    caps = [lim.limit for lim in limits]
    kinds = [None if lim.event_types is None else set(lim.event_types) for lim in limits]
    names = np.array([lim.action for lim in limits] + [None], dtype=object)
    ban_len = hours * _UNIT_US["hour"]
    n = len(limits)

    def decide(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = [compact(p) for p in pdfs if len(p)]
        if not parts:
            return
        ts, ids, applies = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((ids, ts, ts == np.iinfo(np.int64).min))      # null times last
        st = list(state.get) if state.exists else [-1, 0] * n + [0, -1, -1, -1]
        for start in range(0, len(order), CHUNK):
            at = order[start:start + CHUNK]
            st, out = decide_chunk(ts[at], ids[at], applies[at], st)
            yield out.assign(ip_address=key[0])[DECISIONS.names]
        state.update(tuple(st))

    def compact(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Time, id and, as bits, the limits that apply to each row."""
        bits = np.zeros(len(p), np.int64)
        for k, kind in enumerate(kinds):
            bits |= (np.ones(len(p), bool) if kind is None else p["event_type"].isin(kind).to_numpy()).astype(np.int64) << k
        return p["created_at"].to_numpy().astype("datetime64[us]").astype(np.int64), p["id"].to_numpy().astype(np.int64), bits

    def decide_chunk(ts, ids, applies, st: list) -> tuple[list, pd.DataFrame]:
        """State after, and outcomes of, rows in time order."""
        win, cnt = st[0:2 * n:2], st[1:2 * n:2]
        viol, ban_at, ban_id, ban_until = st[2 * n:]

        def in_ban(b_at, b_id, b_until):
            after_point = (ts > b_at) | ((ts == b_at) & (ids > b_id))
            return (b_at >= 0) & after_point & (ts < b_until)

        refused = in_ban(ban_at, ban_id, ban_until)
        refused_by, counted = _stages(ts, applies, ~refused, win, cnt, sizes, caps)
        if ban_at < 0:
            # The ban point is where the running violation count reaches
            # ``after``; rows after it inside the ban are refused and the
            # limits are checked again without them (same prefix, same point).
            total = viol + np.cumsum(refused_by >= 0)
            hit = np.flatnonzero((refused_by >= 0) & (total >= after))
            if hit.size:
                j = hit[0]
                ban_at, ban_id, ban_until = int(ts[j]), int(ids[j]), int(ts[j]) + ban_len
                refused = in_ban(ban_at, ban_id, ban_until)
                refused_by, counted = _stages(ts, applies, ~refused, win, cnt, sizes, caps)
        rejected = refused_by >= 0
        vno = viol + np.cumsum(rejected)
        for k, (rows, w) in enumerate(counted):
            if rows.any():
                last_w = w[rows][-1]
                carried = cnt[k] if last_w == win[k] else 0
                win[k], cnt[k] = int(last_w), int(carried + np.count_nonzero(rows & (w == last_w)))
        viol = int(vno[-1]) if len(vno) else viol
        outcome = np.where(refused, "refused", np.where(rejected, "rejected", "accepted"))
        flat = [int(x) for pair in zip(win, cnt) for x in pair]
        return flat + [viol, int(ban_at), int(ban_id), int(ban_until)], pd.DataFrame(
            {"id": ids, "created_at": ts.astype("datetime64[us]"), "outcome": outcome,
             "action": names[refused_by], "violation_no": vno})

    return decide


def ban_decisions(logs: DataFrame, limits: tuple[RateLimit, ...],
                  after: int = K.DEFAULT_QUOTAS["ban_after_violations"],
                  hours: int = K.DEFAULT_QUOTAS["ban_duration_hours"]) -> DataFrame:
    """Per-event outcome on a streaming (or batch) log, keyed by ip."""
    return (known_ips(logs).select("id", "ip_address", "event_type", "created_at")
            .groupBy("ip_address")
            .applyInPandasWithState(_decider(tuple(limits), after, hours), DECISIONS,
                                    _state_schema(len(limits)), "append", "NoTimeout"))


def bans_from_decisions(decisions: DataFrame, after: int, hours: int) -> DataFrame:
    """Per-ip summary with the columns of the batch ``bans`` result."""
    per_ip = decisions.groupBy("ip_address").agg(
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome") == "rejected").alias("violations"),
        F.count_if(F.col("outcome") == "refused").alias("refused_while_banned"),
        F.min(F.when((F.col("outcome") == "rejected") & (F.col("violation_no") == after),
                     F.col("created_at"))).alias("banned_at"))
    return per_ip.select("ip_address", "accepted", "violations", "refused_while_banned",
                         F.col("banned_at").isNotNull().alias("is_banned"), "banned_at",
                         plus_hours("banned_at", hours).alias("banned_until"))
