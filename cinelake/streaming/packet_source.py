"""Growing media files as a stream of packets.

``spark.readStream.format("growing_packets")`` follows MPEG-TS, IVF and Y4M files that are appended to, and files that appear in the folder.
An offset holds for each file how far it has been read, in bytes and packets; Spark logs it before a batch runs and asks for the
same stretch again after a failure, so that each packet arrives once, whatever is lost or restarted in between.

* IVF and Y4M: a packet arrives with its last byte; ``seq`` is its number in the file.
* MPEG-TS: a packet is whole when the next of its stream begins, and arrives then; ``seq`` is its place in the file (it rises
  along the file).  A batch looks back for the packets that were open at its beginning, so that no state but the offset is
  kept.  The program is that of the tables at the file's beginning.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import containers as C
from ..sources import packet_index as P
from ..sources.files import listed, open_input, size_of
from ..sources.media import SCHEMA, y4m_header

#: How far a file is read: bytes and packets.
Mark = list[int]


@dataclass
class Stretch(InputPartition):
    file: str
    begin: int
    end: int
    first: int


def suffix(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def grown_ivf(path: str, mark: Mark) -> Mark:
    """The end of the last whole frame, from the heads of the frames that are new."""
    size, (at, n) = size_of(path), mark
    with open_input(path) as f:
        if not at:
            head = f.read(32)
            if len(head) < 32:
                return mark
            if head[:4] != b"DKIF":
                raise ValueError(f"{path} is no IVF file")
            at = struct.unpack_from("<H", head, 6)[0]
        while at + 12 <= size:
            f.seek(at)
            stop = at + 12 + struct.unpack("<I", f.read(4))[0]
            if stop > size:
                break
            at, n = stop, n + 1
    return [at, n]


def grown_y4m(path: str, mark: Mark) -> Mark:
    try:
        h = y4m_header(path)
    except (ValueError, KeyError, UnicodeDecodeError):
        if size_of(path) >= 256:
            raise
        return mark  # its first line is not whole yet
    n = max(size_of(path) - h.start, 0) // (h.frame_size + 6)
    return [h.start + n * (h.frame_size + 6), n]


def grown_ts(path: str, mark: Mark) -> Mark:
    return [size_of(path) // P.CELL * P.CELL, 0]


def ivf_packets(f: BinaryIO, part: Stretch) -> Iterator[tuple[int, C.Packet]]:
    for n, e in enumerate(P.ivf_entries(f, part.end, part.begin or None), part.first):
        yield n, C.Packet(0, e.pts, e.dts, bool(e.key), e.position, P.packet_of(f, e.start, e.stop, -1))


def y4m_packets(f: BinaryIO, part: Stretch) -> Iterator[tuple[int, C.Packet]]:
    h = y4m_header(part.file)
    for at in range(max(part.begin, h.start), part.end, h.frame_size + 6):
        n = (at - h.start) // (h.frame_size + 6)
        f.seek(at)
        if f.read(6) != b"FRAME\n":
            raise ValueError(f"{part.file}: frame {n} has parameters of its own")
        yield n, C.Packet(0, n, n, False, at, f.read(h.frame_size))


def ts_streams(f: BinaryIO, end: int) -> dict[int, int]:
    """The streams of the first program table."""
    program = None
    for _, cell in P.cells(f, 0, end):
        pid = (cell[1] & 0x1F) << 8 | cell[2]
        if cell[1] & 0x40:
            if pid == 0:
                program = C.table_programs(P.payload_of(cell))
            elif pid == program:
                return {p: i for i, p in enumerate(C.table_streams(P.payload_of(cell)))}
    return {}


def last_begins(f: BinaryIO, streams: dict[int, int], before: int) -> dict[int, int]:
    """Where each stream's last packet ahead of a place begins, looking back from there."""
    found: dict[int, int] = {}
    stop = before
    while stop > 0 and len(found) < len(streams):
        start = max(stop - 4096 * P.CELL, 0)
        here = {}
        for at, cell in P.cells(f, start, stop):
            if cell[1] & 0x40 and (pid := (cell[1] & 0x1F) << 8 | cell[2]) in streams:
                here[pid] = at
        found = here | found
        stop = start
    return found


def ts_packets(f: BinaryIO, part: Stretch) -> Iterator[tuple[int, C.Packet]]:
    """The packets that are found whole in a stretch: the next of their stream begins there."""
    streams = ts_streams(f, part.end)
    begins = last_begins(f, streams, part.begin)
    open_: dict[int, tuple[int, bytearray]] = {}
    for at, cell in P.cells(f, min(begins.values(), default=part.begin), part.end):
        pid = (cell[1] & 0x1F) << 8 | cell[2]
        if pid not in streams:
            continue
        if cell[1] & 0x40:
            if at < part.begin and begins.get(pid) != at:
                continue
            if pid in open_:
                place, raw = open_[pid]
                p = C.parse_pes(bytes(raw), streams[pid], place)
                if p is not None:
                    yield place, p
            open_[pid] = at, bytearray(P.payload_of(cell))
        elif pid in open_:
            open_[pid][1].extend(P.payload_of(cell))


KINDS = {"ivf": (grown_ivf, ivf_packets), "y4m": (grown_y4m, y4m_packets), "ts": (grown_ts, ts_packets), "m2ts": (grown_ts, ts_packets)}


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("range_bytes", P.RANGE))
        self.seen: dict[str, Mark] = {}

    def initialOffset(self) -> dict:  # noqa: N802  the interface's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for file in listed(self.path):
            if suffix(file) in KINDS:
                before = self.seen.get(file, [0, 0])
                now = KINDS[suffix(file)][0](file, before)
                if now[0] < before[0]:
                    raise ValueError(f"{file} has become shorter")
                self.seen[file] = now
        return {file: mark for file, mark in self.seen.items() if mark[0]}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        parts = []
        for file, (stop, _) in sorted(end.items()):
            self.seen.setdefault(file, [stop, end[file][1]])
            begin, first = start.get(file, [0, 0])
            if suffix(file) in ("ts", "m2ts"):
                step = max(self.size // P.CELL, 1) * P.CELL
                parts += [Stretch(file, at, min(at + step, stop), 0) for at in range(begin, stop, step)]
            elif stop > begin:
                parts.append(Stretch(file, begin, stop, first))
        return parts or [Stretch("", 0, 0, 0)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        if part.file:
            with open_input(part.file) as f:
                for seq, p in KINDS[suffix(part.file)][1](f, part):
                    yield (part.file, p.stream_index, seq, p.pts, p.dts, None, p.keyframe, p.position, len(p.data), p.data)


class GrowingPackets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_packets"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> GrowingReader:  # noqa: N802
        return GrowingReader(self.options)


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The packets of the files at a path, in a folder or that match a glob, as they grow."""
    spark.dataSource.register(GrowingPackets)
    return spark.readStream.format("growing_packets").options(path=path, **options).load()
