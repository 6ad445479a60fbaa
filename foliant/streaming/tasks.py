"""Streams: tasks with a life cycle, progress, windows over late data.

State is bounded by time: a task's ends with its timer, windows and duplicates with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "id long, status string, at timestamp"


def windows(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; windows close when the watermark passes them."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n"))


def admitted(tasks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each task id once; repeats within the watermark are dropped."""
    return tasks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def latest_progress(events: DataFrame) -> DataFrame:
    """id, progress, total, percent: the last report of each task."""
    return events.groupBy("id").agg(F.max_by(F.struct("progress", "total"), "ts").alias("p")).select("id", "p.*", F.round(100 * F.col("p.progress") / F.col("p.total"), 1).alias("percent"))


def life_cycle(events: DataFrame, wait: str = "5 minutes", run: str = "10 minutes", keep: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """id, status, at: what becomes of each task of events (id, kind, ts).

    submit opens a task as waiting, start makes it running, finish done, fetch takes the result.
    A task that waits or runs too long is failed, a result that nobody fetches is dropped; then
    its state goes. Timers run on event time.
    """
    limits = {"waiting": int(pd.Timedelta(wait).total_seconds() * 1000), "running": int(pd.Timedelta(run).total_seconds() * 1000), "done": int(pd.Timedelta(keep).total_seconds() * 1000)}
    moves = {("new", "submit"): "waiting", ("waiting", "start"): "running", ("running", "finish"): "done", ("done", "fetch"): "fetched", ("waiting", "cancel"): "cancelled", ("running", "cancel"): "cancelled"}
    late_moves = {"waiting": "failed", "running": "failed", "done": "dropped"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since = state.get if state.exists else ("new", 0)
        out = []
        if state.hasTimedOut:
            at = since + limits[status]
            out.append((key[0], late_moves[status], pd.Timestamp(at, unit="ms")))
            state.remove()
        else:
            rows = pd.concat(batches).sort_values("ts")
            for kind, ts in zip(rows["kind"], rows["ts"], strict=True):
                now = int(ts.timestamp() * 1000)
                if status in limits and now > since + limits[status]:
                    status = late_moves[status]
                    out.append((key[0], status, ts))
                to = moves.get((status, kind))
                if to:
                    status, since = to, now
                    out.append((key[0], status, ts))
            if status in limits:
                state.update((status, since))
                state.setTimeoutTimestamp(max(since + limits[status], state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["id", "status", "at"])

    return events.withWatermark("ts", late).groupBy("id").applyInPandasWithState(step, STATES, "status string, since long", "append", GroupStateTimeout.EventTimeTimeout)
