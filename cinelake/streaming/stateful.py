"""Structured Streaming forms of the segmenter, the job queue and throughput windows.

State is kept per stream or job; late rows are dropped by the watermark.  The batch operators are the specification.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENT = "stream long, segment int, start long, duration long, size long, packets long"
SEGMENT_STATE = "segment int, start long, last long, size long, packets long"


def stream_segments(packets: DataFrame, target: int, most: int) -> DataFrame:
    """Closed segments of a stream of packets (``stream, seq, pts, size, keyframe``); the open one stays in the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        closed = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for pts, size, keyframe in zip(rows["pts"].tolist(), rows["size"].tolist(), rows["keyframe"].tolist(), strict=True):
            elapsed = max(pts - now[1], 0) if now else 0
            if now is None or (keyframe and elapsed >= target) or elapsed >= most:
                if now:
                    closed.append((key[0], now[0], now[1], now[2] - now[1], now[3], now[4]))
                now = [now[0] + 1 if now else 0, pts, pts, size, 1]
            else:
                now = [now[0], now[1], pts, now[3] + size, now[4] + 1]
        state.update(tuple(now))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return packets.groupBy("stream").applyInPandasWithState(run, SEGMENT, SEGMENT_STATE, "append", GroupStateTimeout.NoTimeout)


JOB = "job_id long, state string, progress double, updates long"
TERMINAL = ("complete", "failed", "cancelled")


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job from events (``job_id, ts, kind, progress``); nothing follows a terminal state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, progress, n = state.get if state.exists else ("queued", 0.0, 0)
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            if kind in TERMINAL:
                break
            kind, progress, n = row.kind, 1.0 if row.kind == "complete" else row.progress, n + 1
        state.update((kind, progress, n))
        yield pd.DataFrame({"job_id": [key[0]], "state": [kind], "progress": [progress], "updates": [n]})

    return events.groupBy("job_id").applyInPandasWithState(run, JOB, "state string, progress double, updates long", "update", GroupStateTimeout.NoTimeout)


def stale_workers(beats: DataFrame, timeout_seconds: int) -> DataFrame:
    """Workers (``worker_id, ts``) that stay silent for the timeout by event time, each once per silence."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"worker_id": [key[0]], "last_ms": [last]})
            return
        last = max([int(b["ts"].max().timestamp() * 1000) for b in batches] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker_id": pd.Series([], dtype="int64"), "last_ms": pd.Series([], dtype="int64")})

    watched = beats.withWatermark("ts", "0 seconds")
    return watched.groupBy("worker_id").applyInPandasWithState(run, "worker_id long, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def throughput(packets: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bytes and packets of each stream and tumbling window of event time (``ts``)."""
    return packets.withWatermark("ts", late).groupBy("stream", F.window("ts", window)).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
