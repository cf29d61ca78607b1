"""Segment packages written by a stream: files of closed segments and a playlist for each stream.

``closed_segments`` keeps the packets of each stream's open segment in the state and lets them go, all at once, when the
next one begins; the state is bounded by a segment.  The sink writes a segment to a file of its task's attempt.  A micro-batch's
commit moves its files to their names and rewrites the playlists of its streams.  Names and contents follow from the packets alone, and the log
of a stream's segments is kept by their numbers, so that a batch that is killed at any point and runs again leaves what one run leaves: the package of
the batch form (``packages.hls_package``), byte for byte.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.control import playlist_text
from ..sources.files import listed, move, open_input, open_output, remove
from ..sources.sinks import create_muxer

HELD = pa.schema([("stream_index", pa.int32()), ("seq", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("keyframe", pa.bool_()), ("data", pa.binary())])
CLOSED = "stream long, segment int, duration long, ended boolean, _total long, _count long, stream_index int, seq long, pts long, dts long, keyframe boolean, data binary"


def _stored(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(HELD)], schema=HELD))
    return sink.getvalue().to_pybytes()


def _restored(raw: bytes) -> list[tuple]:
    return list(zip(*[c.to_pylist() for c in pa.ipc.open_stream(raw).read_all().columns], strict=True))


def closed_segments(packets: DataFrame, target: int, most: int) -> DataFrame:
    """The packets of each segment once it is closed, in order, with its number, duration and size.

    ``packets``: ``stream, seq, pts, dts, keyframe, stream_index, data``, in order of ``seq`` over the batches of a stream.
    A segment begins at a keyframe once ``target`` ms have passed, or at ``most`` ms.  A row without ``pts`` ends its
    stream: the open segment is closed and marked.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, last, held = -1, 0, 0, []
        if state.exists:
            number, start, last, raw = state.get
            held = _restored(raw)
        out: list[tuple] = []

        def close(ended: bool) -> None:
            total, count = sum(len(r[5]) for r in held), len(held)
            out.extend((key[0], number, last - start, ended, total, count, *r) for r in held)

        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        ended = False
        for index, seq, pts, dts, keyframe, data in zip(*(rows[c].tolist() for c in ("stream_index", "seq", "pts", "dts", "keyframe", "data")), strict=True):
            if pd.isna(pts):
                ended = True
                break
            pts = int(pts)
            elapsed = max(pts - start, 0)
            if not held or (keyframe and elapsed >= target) or elapsed >= most:
                close(False)
                number, start, held = number + 1, pts, []
            last = pts
            held.append((int(index), int(seq), pts, pts if pd.isna(dts) else int(dts), bool(keyframe), bytes(data)))
        if ended:
            close(True)
            if state.exists:
                state.remove()
        else:
            state.update((number, start, last, _stored(held)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])

    own = packets.select("stream", "stream_index", "seq", "pts", "dts", "keyframe", "data")
    return own.groupBy("stream").applyInPandasWithState(run, CLOSED, "segment int, start long, last long, held binary", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Closed(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)
    segments: list[tuple[int, int, int, bool]] = field(default_factory=list)  # stream, number, duration, whether it is the last


class SegmentWriter(DataSourceStreamWriter):
    """The options: ``path``, ``kind`` (of the sinks), ``target_seconds``, ``name`` of the files, and those of the kind."""

    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.name = options.get("name", "%d/segment_%05d.ts")
        create_muxer(options["kind"], options)

    def write(self, iterator: Iterator[Row]) -> Closed:
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        made, now, out, muxer = Closed(), None, None, None
        for row in iterator:
            if (row.stream, row.segment) != now:
                if out is not None:
                    out.write(muxer.tail())
                    out.close()
                now = (row.stream, row.segment)
                target = f"{self.path}/{self.name % now}"
                made.files.append((f"{target}.{attempt}.part", target))
                made.segments.append((row.stream, row.segment, row.duration, row.ended))
                out, muxer = open_output(made.files[-1][0]), create_muxer(self.options["kind"], self.options)
                out.write(muxer.head(row._total, row._count))
            out.write(muxer.packet(row))
        if out is not None:
            out.write(muxer.tail())
            out.close()
        return made

    def commit(self, messages: list[Closed | None], batchId: int) -> None:  # noqa: N803  the interface's name
        """Files first, then the log, then the playlist: a reader of a playlist finds all that it lists."""
        done = [m for m in messages if m is not None]
        for part, target in (f for m in done for f in m.files):
            move(part, target)
        by_stream: dict[int, list[tuple[int, int, bool]]] = {}
        for stream, *segment in (s for m in done for s in m.segments):
            by_stream.setdefault(stream, []).append(tuple(segment))
        for stream, segments in by_stream.items():
            log = self._log(stream) | {str(n): [duration, ended] for n, duration, ended in segments}
            self._put(f"_log/{stream}.json", json.dumps(log))
            ordered = sorted((int(n), duration, ended) for n, (duration, ended) in log.items())
            self._put(f"{stream}/media.m3u8", playlist_text([x[:2] for x in ordered], int(self.options["target_seconds"]), any(x[2] for x in ordered)))
            for stale in listed(f"{self.path}/{stream}/*.part"):  # of attempts that were killed
                remove(stale)

    def abort(self, messages: list[Closed | None], batchId: int) -> None:  # noqa: N803
        for part, _ in (f for m in messages if m for f in m.files):
            remove(part)

    def _log(self, stream: int) -> dict:
        if not listed(f"{self.path}/_log/{stream}.json"):
            return {}
        with open_input(f"{self.path}/_log/{stream}.json") as f:
            return json.loads(f.read())

    def _put(self, name: str, text: str) -> None:
        with open_output(f"{self.path}/{name}.part") as f:
            f.write(text.encode())
        move(f"{self.path}/{name}.part", f"{self.path}/{name}")


class SegmentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment_package"

    def schema(self) -> str:
        return CLOSED

    def streamWriter(self, schema: object, overwrite: bool) -> SegmentWriter:  # noqa: N802
        return SegmentWriter(self.options)


def write_segments(packets: DataFrame, folder: str, checkpoint: str, target: int, most: int, kind: str = "ts", once: bool = False, **options: str) -> StreamingQuery:
    """Start the query that packages a stream of packets below a folder; with ``once`` it ends when it has caught up."""
    packets.sparkSession.dataSource.register(SegmentSink)
    writer = closed_segments(packets, target, most).writeStream.format("segment_package").outputMode("append")
    writer = writer.options(path=folder, kind=kind, target_seconds=str(target // 1000), checkpointLocation=checkpoint, **options)
    return (writer.trigger(availableNow=True) if once else writer).start()
