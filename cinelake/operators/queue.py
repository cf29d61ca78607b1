"""The log of a transcode queue: what each event does, and what state it leaves, as a fold over the ordered events.

Events (``queue, seq, ts, kind, job_id, worker_id, value``) of one queue are applied in order.  The state holds jobs that
are not done, the last states of those that are, and workers; it is the same in batch (:func:`outcomes`) and in a
stream (:func:`stream_outcomes`), where it is kept as text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .folds import ordered_fold

OUTCOME = "queue long, seq long, accepted boolean, note string, depth int"
TERMINAL = ("complete", "failed", "cancelled")


class Queue:
    """Jobs wait, run on workers and end; a full queue refuses jobs, and workers that fall silent lose theirs."""

    def __init__(self, most: int, timeout: int, held: dict | None = None):
        self.most, self.timeout = most, timeout
        held = held or {}
        self.jobs: dict[str, list] = held.get("jobs", {})  # state, worker, progress
        self.workers: dict[str, list] = held.get("workers", {})  # last beat, whether it is online

    def held(self) -> dict:
        return {"jobs": self.jobs, "workers": self.workers}

    def depth(self) -> int:
        return sum(j[0] == "queued" for j in self.jobs.values())

    def apply(self, ts: int, kind: str, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        """Whether the event is accepted, and what it did."""
        return getattr(self, f"_{kind}", self._unknown)(ts, job, worker, value)

    def _unknown(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        return False, "unknown kind"

    def _register(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        self.workers[worker] = [ts, True]
        return True, "online"

    def _heartbeat(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        if worker not in self.workers:
            return False, "unknown worker"
        self.workers[worker][0] = ts
        return True, ""

    def _enqueue(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        if self.depth() >= self.most:
            return False, "queue is full"
        if job in self.jobs:
            return False, "known job"
        self.jobs[job] = ["queued", None, 0.0]
        return True, "queued"

    def _start(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        if self.jobs.get(job, [""])[0] != "queued" or not self.workers.get(worker, [0, False])[1]:
            return False, "cannot start"
        self.jobs[job] = ["running", worker, 0.0]
        return True, "running"

    def _progress(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        if self.jobs.get(job, [""])[0] != "running":
            return False, "not running"
        self.jobs[job][2] = value or 0.0
        return True, "running"

    def _end(self, job: str, state: str) -> tuple[bool, str]:
        if self.jobs.get(job, [""])[0] != "running":
            return False, "not running"
        self.jobs[job] = [state, None, 1.0 if state == "complete" else self.jobs[job][2]]  # its worker has a slot again
        return True, state

    def _complete(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        return self._end(job, "complete")

    def _fail(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        return self._end(job, "failed")

    def _cancel(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        if self.jobs.get(job, ["cancelled"])[0] in TERMINAL:
            return False, "done or unknown"
        self.jobs[job][:2] = ["cancelled", None]
        return True, "cancelled"

    def _check(self, ts: int, job: str, worker: str, value: float | None) -> tuple[bool, str]:
        """Workers that have been silent for the timeout go offline, and what they ran waits again."""
        lost = [w for w, (beat, online) in self.workers.items() if online and ts - beat >= self.timeout]
        for w in lost:
            self.workers[w][1] = False
        back = sorted(j for j, (state, w, _) in self.jobs.items() if state == "running" and w in lost)
        for j in back:
            self.jobs[j] = ["queued", None, 0.0]
        return True, ",".join(back)


class _Log:
    def __init__(self, key: tuple, most: int, timeout: int):
        self.key, self.queue = key[0], Queue(most, timeout)

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for e in rows.to_pylist():
            done = self.queue.apply(e["ts"], e["kind"], str(e["job_id"]), str(e["worker_id"]), e["value"])
            out.append((self.key, e["seq"], *done, self.queue.depth()))
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [c.split()[0] for c in OUTCOME.split(", ")])

    def finish(self) -> None:
        return None


def _typed(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(c).cast(t).alias(c) for c, t in (("queue", "long"), ("seq", "long"), ("ts", "long"), ("kind", "string"), ("job_id", "long"), ("worker_id", "long"), ("value", "double"))])


def outcomes(events: DataFrame, most: int, timeout: int) -> DataFrame:
    """``queue, seq, accepted, note, depth``: what each event did, and how many jobs wait after it."""
    return ordered_fold(_typed(events), ["queue"], ["seq"], lambda key: _Log(key, most, timeout), OUTCOME)


def stream_outcomes(events: DataFrame, most: int, timeout: int) -> DataFrame:
    """The same over a stream of events, each micro-batch in the order of ``seq``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue = Queue(most, timeout, json.loads(state.get[0]) if state.exists else None)
        out = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            name = lambda x: str(None if pd.isna(x) else int(x))
            done = queue.apply(int(e.ts), e.kind, name(e.job_id), name(e.worker_id), None if pd.isna(e.value) else float(e.value))
            out.append((key[0], e.seq, *done, queue.depth()))
        state.update((json.dumps(queue.held()),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    return _typed(events).groupBy("queue").applyInPandasWithState(run, OUTCOME, "held string", "append", GroupStateTimeout.NoTimeout)


def progress_feed(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """What a watcher of each job sees: its state now, then every later update up to the one that ends it.

    ``jobs``: ``job_id, state, seq``; ``updates``: ``job_id, seq, state, progress``.
    """
    from pyspark.sql import Window as W

    now = jobs.select("job_id", "seq", "state", F.lit(None).cast("double").alias("progress"), F.lit(0).alias("_later"))
    later = updates.join(jobs.select("job_id", F.col("seq").alias("_from"), F.col("state").alias("_now")), "job_id").filter((F.col("seq") > F.col("_from")) & ~F.col("_now").isin(*TERMINAL))
    order = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("state").isin(*TERMINAL)).over(order), F.lit(False))
    later = later.withColumn("_over", over).filter("NOT _over")
    return now.drop("_later").unionByName(later.select("job_id", "seq", "state", "progress"))


def latency_window(packets: DataFrame, last: int = 1000) -> DataFrame:
    """``stream, n, mean, most``: latencies (``done - sent``) of the last packets of each stream."""
    from pyspark.sql import Window as W

    newest = W.partitionBy("stream").orderBy(F.col("seq").desc())
    rows = packets.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= last).withColumn("_l", F.col("done") - F.col("sent"))
    return rows.groupBy("stream").agg(F.count("*").alias("n"), F.avg("_l").alias("mean"), F.max("_l").alias("most"))
