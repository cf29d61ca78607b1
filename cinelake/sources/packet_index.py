"""Splittable scans of packet containers: an index first, then the bytes.

Any file is reduced to a packet index, a row per packet with its place and times but without its bytes.

* MPEG-TS files are cut in byte ranges at whole cells.  A range describes the packets that begin in it, reading on until the last of them
  has ended; one ordered fold per file over these descriptions (a few numbers a packet) replays the tables and numbers the packets.
* FLAC files are cut in byte ranges too: a frame's head is told by its own bytes.
* Matroska files are cut at their clusters, which are found by hopping over them.
* AVI files give their idx1 table, or the heads of their chunks where there is none; IVF and MP4 files the heads and tables
  that say where each frame lies.  These are read piece by piece, without the frames.

``fetch`` deals the index out by byte ranges and reads the packets.  What is filtered before (numbers, times, streams,
keyframes) is never read, so that a seek into a long file reads the packets it needs.  No file, table or stream is held
in one cell; a task holds one range's description.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers as C
from . import streams
from .files import open_input
from .media import SCHEMA

CELL = 188
RANGE = 64 << 20
#: Entries of a piece of an index, and bytes of packets in an Arrow batch.
PIECE, BATCH = 16384, 8 << 20
INDEX = "file string, stream_index int, seq bigint, pts bigint, dts bigint, keyframe boolean, position bigint, size int, start bigint, stop bigint, pid int"
KINDS = {"ts": "ts", "m2ts": "ts", "avi": "avi", "ivf": "ivf", **dict.fromkeys(("mkv", "mka", "mks", "webm"), "matroska"), **dict.fromkeys(("mp4", "m4v", "m4a"), "mp4"), "flac": "flac"}


class Entry(NamedTuple):
    """A packet, or for MPEG-TS whatever begins in a cell: ``section`` holds what may be a table, ``valid`` says whether it is a packet."""

    stream: int
    pts: int
    dts: int
    key: bool | None
    position: int
    size: int
    start: int
    stop: int
    pid: int = -1
    valid: bool = True
    section: bytes | None = None


TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
PIECES = "file string, kind string, piece bigint, " + ", ".join(f"{n} array<{t}>" for n, t in zip(Entry._fields, ("int", "bigint", "bigint", "boolean", "bigint", "int", "bigint", "bigint", "int", "boolean", "binary"), strict=True))


def cells(f: BinaryIO, at: int, stop: int, read: int = CELL * 4096) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the whole cells from ``at`` on."""
    f.seek(at)
    while at + CELL <= stop:
        raw = f.read(min(read, (stop - at) // CELL * CELL))
        if len(raw) < CELL:
            return
        for i in range(0, len(raw) - CELL + 1, CELL):
            if raw[i] != 0x47:
                raise ValueError(f"lost synchronisation at {at + i}")
            yield at + i, raw[i : i + CELL]
        at += len(raw) // CELL * CELL
        f.seek(at)


def payload_of(cell: bytes) -> bytes:
    control = cell[3] >> 4 & 3
    return cell[4 + (cell[4] + 1 if control & 2 else 0) :] if control & 1 else b""


def ts_entries(f: BinaryIO, begin: int, end: int, length: int) -> Iterator[Entry]:
    """What begins between ``begin`` and ``end``, in order of its begin; the last packets are read to their end."""
    open_: dict[int, list] = {}  # pid: place, end, payload
    done: list[Entry] = []

    def close(pid: int) -> None:
        place, stop, raw = open_.pop(pid)
        p = C.parse_pes(bytes(raw), 0, place)
        done.append(Entry(0, p.pts, p.dts, p.keyframe, place, len(p.data), place, stop, pid) if p else Entry(0, 0, 0, False, place, 0, place, stop, pid, False))

    for at, cell in cells(f, begin, length):
        if at >= end and not open_:
            break
        first, pid = bool(cell[1] & 0x40), (cell[1] & 0x1F) << 8 | cell[2]
        if first:
            if pid in open_:
                close(pid)
            if at < end:
                payload = payload_of(cell)
                if payload[:3] == b"\0\0\1":
                    open_[pid] = [at, at + CELL, bytearray(payload)]
                else:
                    done.append(Entry(0, 0, 0, False, at, 0, at, at + CELL, pid, False, payload))
        elif pid in open_:
            open_[pid][1] = at + CELL
            open_[pid][2] += payload_of(cell)
    for pid in list(open_):
        close(pid)
    return iter(sorted(done, key=lambda e: e.position))


class TsNumbers:
    """Replays a transport stream's tables and packets in order; a packet is whole when the next of its stream begins."""

    def __init__(self) -> None:
        self.program: int | None = None
        self.streams: dict[int, int] = {}
        self.open: dict[int, Entry] = {}

    def step(self, entries: Iterator[Entry]) -> Iterator[Entry]:
        for e in entries:
            if e.pid == 0:
                self.program = C.table_programs(e.section) if e.section else self.program
            elif e.pid == self.program:
                self.streams = {p: i for i, p in enumerate(C.table_streams(e.section))} if e.section else self.streams
            elif e.pid in self.streams:
                before = self.open.get(e.pid)
                if before is not None and before.valid:
                    yield before._replace(stream=self.streams[e.pid])
                self.open[e.pid] = e

    def finish(self) -> Iterator[Entry]:
        for pid, e in sorted(self.open.items(), key=lambda x: x[1].position):
            if e.valid:
                yield e._replace(stream=self.streams.get(pid, 0))


class InOrder:
    """Entries that are numbered as they come."""

    def step(self, entries: Iterator[Entry]) -> Iterator[Entry]:
        return iter(entries)

    def finish(self) -> Iterator[Entry]:
        return iter(())


def ivf_entries(f: BinaryIO, length: int, at: int | None = None) -> Iterator[Entry]:
    """Whole frames from their heads on (or from ``at``, where a frame begins)."""
    if at is None:
        f.seek(0)
        head = f.read(32)
        if head[:4] != b"DKIF":
            raise ValueError("no IVF file")
        at = struct.unpack_from("<H", head, 6)[0]
    while at + 12 <= length:
        f.seek(at)
        head = f.read(13)
        size, pts = struct.unpack_from("<IQ", head)
        held = min(size, length - at - 12)
        yield Entry(0, pts, pts, held > 0 and not head[12] & 1, at, held, at + 12, at + 12 + held)
        at += 12 + size


def avi_entries(f: BinaryIO, length: int) -> Iterator[Entry]:
    """Packets by the index, else by the chunks' heads; a video chunk's keyframe flag is then told by its bytes (None here)."""
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= length:
        f.seek(at)
        head = f.read(12)
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if name == b"LIST" and head[8:] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + size % 2
    if movi is None:
        return
    counts: dict[int, int] = {}
    for name, key, offset, size in _indexed(f, *index) if index is not None and index[1] >= 16 else _walked(f, *movi):
        if name[:2].isdigit():
            n, start = int(name[:2]), movi[0] + offset + 8
            counts[n] = counts.get(n, -1) + 1
            held = max(min(size, length - start), 0)
            yield Entry(n, counts[n], counts[n], key, start, held, start, start + held)


def _indexed(f: BinaryIO, at: int, size: int) -> Iterator[tuple[bytes, bool, int, int]]:
    for i in range(at, at + size - 15, 16 * PIECE):
        f.seek(i)
        raw = f.read(min(16 * PIECE, (at + size - i) // 16 * 16))
        for name, flags, offset, length in struct.iter_unpack("<4sIII", raw[: len(raw) // 16 * 16]):
            yield name, bool(flags & 0x10), offset, length


def _walked(f: BinaryIO, start: int, stop: int) -> Iterator[tuple[bytes, bool | None, int, int]]:
    at = start + 4
    while at + 8 <= stop:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            return
        size = struct.unpack_from("<I", head, 4)[0]
        yield head[:4], True if head[2:4] == b"wb" else None, at - start, size
        at += 8 + size + size % 2


def mp4_entries(f: BinaryIO, length: int) -> Iterator[Entry]:
    """The samples of all tracks in reading order, from the tables of the moov box."""
    tracks = streams.tracks_of(streams.movie(f))
    starts = []
    for t in tracks:
        total, at = 0, []
        for d in t.times:
            at.append(total)
            total += d
        starts.append(at)
    for n, number in streams.mp4_samples(tracks):
        t, place = tracks[number], tracks[number].places[n - 1]
        time = starts[number][n - 1] if n <= len(starts[number]) else 0
        yield Entry(number, time, time, t.sync is None or n in t.sync, place, t.sizes[n - 1], place, place + t.sizes[n - 1])


class Cluster(NamedTuple):
    begin: int
    end: int
    scale: int
    tracks: list[int]


def clusters(f: BinaryIO, length: int) -> Iterator[Cluster]:
    """The clusters of a Matroska file with what stands ahead of them; those of unknown size end where the next begins."""
    scale, tracks, open_ = 1_000_000, [], None
    first = True
    todo = [(0, length)]
    while todo:
        at, stop = todo.pop()
        f.seek(at)
        for ident, begin, size in streams.elements(f, stop):
            if first and ident != streams.EBML:
                raise ValueError("no Matroska file")
            first = False
            if open_ is not None and ident in (streams.CLUSTER, streams.SEGMENT, streams.INFO, streams.TRACKS, CUES):
                yield Cluster(open_, begin, scale, tracks)
                open_ = None
            if ident in (streams.SEGMENT, streams.INFO, streams.TRACKS) and size != streams.UNKNOWN:
                todo += [(begin + size, stop), (begin, begin + size)]
                break
            if ident == streams.TIME_SCALE:
                f.seek(begin)
                scale = int.from_bytes(f.read(size), "big")
            elif ident == streams.TRACK:
                f.seek(begin)
                for part, b, n in streams.elements(f, begin + size):
                    if part == streams.TRACK_NUMBER:
                        f.seek(b)
                        tracks = [*tracks, int.from_bytes(f.read(n), "big")]
            elif ident == streams.CLUSTER:
                if size == streams.UNKNOWN:
                    open_ = begin
                else:
                    yield Cluster(begin, min(begin + size, length), scale, tracks)
    if open_ is not None:
        yield Cluster(open_, length, scale, tracks)


#: Fixed value: the identifier of the table of cue points, which may follow the clusters.
CUES = 0x1C53BB6B


def cluster_entries(f: BinaryIO, c: Cluster) -> Iterator[Entry]:
    """The frames of a cluster from the heads of its blocks; the bodies of laced blocks, which hold several, are read."""
    time, number = 0, {t: i for i, t in enumerate(c.tracks)}

    def block(at: int, size: int, key: bool | None) -> Iterator[Entry]:
        f.seek(at)
        raw = f.read(min(size, 16))
        track, n = streams.varint(raw)
        relative, flags = struct.unpack_from(">hB", raw, n)
        pts = (time + relative) * c.scale // 1_000_000
        own = (number.get(track, track - 1), pts, pts, bool(flags & 0x80) if key is None else key, at)
        begin = at + n + 3
        if not flags & 6:
            yield Entry(*own, size - n - 3, begin, at + size)
            return
        f.seek(begin)
        frames = streams.laced(f.read(size - n - 3), flags)
        begin = at + size - sum(map(len, frames)) if flags & 6 != 4 else begin + 1
        for frame in frames:
            yield Entry(*own, len(frame), begin, begin + len(frame))
            begin += len(frame)

    f.seek(c.begin)
    for ident, at, size in streams.elements(f, c.end):
        if ident == streams.CLUSTER_TIME:
            f.seek(at)
            time = int.from_bytes(f.read(size), "big")
        elif ident == streams.SIMPLE_BLOCK:
            yield from block(at, size, None)
        elif ident == streams.BLOCK_GROUP:
            f.seek(at)
            parts = list(streams.elements(f, at + size))
            for part, begin, length in parts:
                if part == streams.BLOCK:
                    yield from block(begin, length, all(p != streams.REFERENCE for p, _, _ in parts))


def flac_entries(f: BinaryIO, begin: int, end: int, length: int) -> Iterator[Entry]:
    """The frames that begin between ``begin`` and ``end``; the time is the number of the first sample."""
    from .flac import heads, stream_info

    base = stream_info(f)[1]
    size = next((head[1] for _, head in heads(f, base, length, 4096)), 0)
    before = None
    for at, (number, _, by_sample) in heads(f, max(begin, base), length):
        if before is not None:
            yield Entry(0, before[1], before[1], True, before[0], at - before[0], before[0], at)
        before = (at, number if by_sample else number * size) if at < end else None
        if before is None:
            return
    if before is not None:
        yield Entry(0, before[1], before[1], True, before[0], length - before[0], before[0], length)


CUT: dict[str, Callable[[BinaryIO, int, int, int], Iterator[Entry]]] = {"ts": ts_entries, "flac": flac_entries}
WHOLE: dict[str, Callable[[BinaryIO, int], Iterator[Entry]]] = {"ivf": ivf_entries, "avi": avi_entries, "mp4": mp4_entries}


def pieces_of(file: str, kind: str, entries: Iterator[Entry], number: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of an index, ``PIECE`` entries each, or one row with the given number."""
    held: list[Entry] = []
    count = 0

    def row(piece: int) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [()] * len(TYPES)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(c, t)) for c, t in zip(columns, TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([kind]), pa.array([piece], pa.int64()), *lists], ["file", "kind", "piece", *Entry._fields])

    for e in entries:
        held.append(e)
        if number is None and len(held) >= PIECE:
            yield row(count)
            held, count = [], count + 1
    if held:
        yield row(count if number is None else number)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, kind`` of the containers at a path or glob, without their contents; other files are left out."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    suffix = F.lower(F.substring_index("file", ".", -1))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return listed.withColumn("kind", F.try_element_at(kinds, suffix)).filter("kind is not null")


def ranges(found: DataFrame, size: int) -> DataFrame:
    """Byte ranges of the files, of whole cells."""
    step = max(size // CELL, 1) * CELL
    last = F.greatest(F.expr(f"(length - 1) div {step}"), F.lit(0))
    return found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).withColumn("begin", F.col("piece") * step).withColumn("end", F.least(F.col("begin") + step, F.col("length")))


def tasks_of(found: DataFrame, size: int) -> int:
    """As many tasks as all files together have ranges, and as many as can run at once if there are so many files."""
    total, count = found.agg(F.sum("length"), F.count("*")).first()
    return max(-(-(total or 0) // size), min(count, found.sparkSession.sparkContext.defaultParallelism), 1)


def index(spark: SparkSession, path: str, range_bytes: int = RANGE, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The packet index of all containers (of some kinds) at a path or glob.  It may be written as a table and used again for the same files."""
    found = files(spark, path)
    found = found.filter(F.col("kind").isin(*kinds)) if kinds else found
    tasks = tasks_of(found, range_bytes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open_input(r["file"]) as f:
                    yield from pieces_of(r["file"], r["kind"], CUT[r["kind"]](f, r["begin"], r["end"], r["length"]), r["piece"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open_input(r["file"]) as f:
                    yield from pieces_of(r["file"], r["kind"], WHOLE[r["kind"]](f, r["length"]))

    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open_input(r["file"]) as f:
                    rows = [(r["file"], k, *c) for k, c in enumerate(clusters(f, r["length"]))]
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "piece", "begin", "end", "scale", "tracks"), x, strict=True)) for x in rows], schema=CLUSTERS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open_input(r["file"]) as f:
                    yield from pieces_of(r["file"], "matroska", cluster_entries(f, Cluster(r["begin"], r["end"], r["scale"], r["tracks"])), r["piece"])

    cut = ranges(found.filter(F.col("kind").isin(*CUT)), range_bytes).repartition(tasks, "file", "piece").mapInArrow(part, PIECES)
    single = found.filter(F.col("kind").isin(*WHOLE)).repartition(tasks, "file").mapInArrow(whole, PIECES)
    parts = found.filter("kind = 'matroska'").repartition(tasks, "file").mapInArrow(hop, "file string, piece bigint, begin bigint, end bigint, scale bigint, tracks array<bigint>")
    parts = parts.repartition(tasks, "file", F.expr(f"begin div {range_bytes}")).mapInArrow(blocks, PIECES)
    return numbered(cut.unionByName(single).unionByName(parts))


CLUSTERS = pa.schema([("file", pa.string()), ("piece", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("scale", pa.int64()), ("tracks", pa.list_(pa.int64()))])


def numbered(pieces: DataFrame) -> DataFrame:
    """The packets of all pieces with their numbers: one ordered pass per file over descriptions, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, fold, seq = None, InOrder(), 0

        def rows(entries: Iterator[Entry]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            held = list(entries)
            if held:
                columns = list(zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(held), pa.string()), pa.array(columns[0], pa.int32()), pa.array(range(seq, seq + len(held)), pa.int64()), *[pa.array(c, t) for c, t in zip(columns[1:9], TYPES[1:9], strict=True)]],
                    [x.split()[0] for x in INDEX.split(", ")],
                )
                seq += len(held)

        for b in batches:
            for k in range(b.num_rows):
                own, kind, _, *lists = (b.column(i)[k] for i in range(b.num_columns))
                if own.as_py() != file:
                    yield from rows(fold.finish())
                    file, fold, seq = own.as_py(), TsNumbers() if kind.as_py() == "ts" else InOrder(), 0
                yield from rows(fold.step(map(Entry, *[x.values.to_pylist() for x in lists])))
        yield from rows(fold.finish())

    return pieces.repartition("file").sortWithinPartitions("file", "piece").mapInArrow(run, INDEX)


def packet_of(f: BinaryIO, start: int, stop: int, pid: int) -> bytes:
    """A packet's bytes; in a transport stream those of its cells, without the head that they begin with."""
    if pid < 0:
        f.seek(start)
        return f.read(stop - start)
    raw = b"".join(payload_of(c) for _, c in cells(f, start, stop) if (c[1] & 0x1F) << 8 | c[2] == pid)
    return raw[9 + raw[8] :]


def fetch(found: DataFrame, tasks: int, range_bytes: int = RANGE) -> DataFrame:
    """The packets of (part of) an index with their bytes, dealt out by byte ranges."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, made, held = None, None, [], 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names)

        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["file"] != path:
                        if f is not None:
                            f.close()
                        path, f = r["file"], open_input(r["file"])
                    data = packet_of(f, r["start"], r["stop"], r["pid"])
                    key = C.has_keyframe(data) if r["keyframe"] is None else r["keyframe"]
                    made.append((path, r["stream_index"], r["seq"], r["pts"], r["dts"], None, key, r["position"], len(data), data))
                    held += len(data)
                    if held > BATCH:
                        yield batch()
                        made, held = [], 0
            if made:
                yield batch()
        finally:
            if f is not None:
                f.close()

    return found.repartition(tasks, "file", F.expr(f"start div {range_bytes}")).sortWithinPartitions("file", "start").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE, where: str | Column | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The packets of all MPEG-TS, Matroska, MP4, AVI, IVF and FLAC files at a path or glob, by extension; others are left out.

    ``where`` is a condition on the index (``file, stream_index, seq, pts, dts, keyframe, position, size``): only the
    bytes of packets that meet it are read.  ``kinds`` leaves out all other kinds of files.
    """
    found = index(spark, path, range_bytes, kinds)
    return fetch(found if where is None else found.filter(where), tasks_of(files(spark, path), range_bytes), range_bytes)
