"""Timers over streams: keys that are polled no more often than their interval, one at a time, and items that have settled.

State is one small row a key, however many events it has: when it was last let through, and until when it is busy. Event-time
timeouts give a key's state up when nothing more can depend on it. Late events, which are older than the watermark, are dropped
by the engine; an event that is delivered again is older than what its key has seen, so it is not let through twice.

The batch twin hands the same state from row to row of a key in order, in batches, so a hot key needs no memory of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notelode.plans.catalog import query
from notelode.plans.store import table

POLLED = "key long, at long, event_id long"


def due_polls(requests: DataFrame) -> DataFrame:
    """key, at, event_id: the requests (key, at in seconds, event_id, every in seconds) that are let through: a key's first, and each
    that is its interval or more after the one before. Rows without key, time or interval are not; ties go to the smaller event_id."""
    rows = requests.select("key", "at", "event_id", "every").where("key is not null and at is not null and every is not null")
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        key = last = None
        for b in batches:
            keep = np.zeros(len(b), bool)
            for i, (k, at, every) in enumerate(zip(b["key"].tolist(), b["at"].tolist(), b["every"].tolist(), strict=True)):
                if k != key or at >= last + every:
                    key, last, keep[i] = k, at, True
            yield b[["key", "at", "event_id"]][keep]

    return rows.mapInPandas(run, POLLED)


def poll_stream(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream of requests (key, ts, event_id, every); between triggers a key's state is its last time. Events of a
    trigger are taken in order of time."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for at, event, every in rows[["at", "event_id", "every"]].itertuples(index=False):
            if last is None or at >= last + every:
                last = at
                out.append((key[0], at, event))
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((last + rows["every"].max()) * 1000)))
        yield pd.DataFrame(out, columns=["key", "at", "event_id"])

    timed = requests.where("key is not null and ts is not null and every is not null").withWatermark("ts", late)
    timed = timed.select("key", "ts", F.unix_seconds("ts").alias("at"), "event_id", "every")
    return timed.groupBy("key").applyInPandasWithState(run, POLLED, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def settled(changes: DataFrame, gap: int, tries: int = 3, late: str = "1 hour") -> DataFrame:
    """key, at, changes, gave_up: items (key, ts) when they have not changed for gap seconds, with the time of the last change, or after
    ``tries`` times that they were looked at and had changed again. A timer is set for each item; it is gone once it is told."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        last, seen, looked = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], last, seen, False))
            seen = 0
        else:
            for at in sorted(x for b in batches for x in b["at"].tolist()):
                if seen and at >= last + gap:  # it had settled before this change came
                    out.append((key[0], last, seen, False))
                    seen = looked = 0
                looked += seen > 0
                last, seen = max(at, last if seen else at), seen + 1
            if looked >= tries:
                out.append((key[0], last, seen, True))
                seen = 0
        if seen:
            state.update((last, seen, looked))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + gap) * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at", "changes", "gave_up"])

    timed = changes.where("key is not null and ts is not null").withWatermark("ts", late).select("key", "ts", F.unix_seconds("ts").alias("at"))
    return timed.groupBy("key").applyInPandasWithState(run, "key long, at long, changes long, gave_up boolean", "last long, seen long, looked long", "append", GroupStateTimeout.EventTimeTimeout)


@query(
    'WITH RECURSIVE r AS (SELECT user_id AS key, floor(epoch(ts))::bigint AS "at", event_id, (c_nationkey + 1) * 3600 AS every, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::bigint, event_id) AS n FROM events JOIN customer ON c_custkey = user_id), '
    'w AS (SELECT key, "at", event_id, every, n, "at" AS last, true AS let FROM r WHERE n = 1 UNION ALL SELECT r.key, r."at", r.event_id, r.every, r.n, CASE WHEN r."at" >= w.last + r.every THEN r."at" ELSE w.last END, r."at" >= w.last + r.every FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1) SELECT key, "at", event_id FROM w WHERE let'
)
def polls_let_through(spark, sf_dir) -> DataFrame:
    """Which events of each user would poll, if users are polled as often as their nation allows."""
    from notelode.operators.lists import seconds

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), seconds("ts").alias("at"), "event_id")
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), ((F.col("c_nationkey") + 1) * 3600).cast("long").alias("every"))
    return due_polls(e.join(every, "key"))
