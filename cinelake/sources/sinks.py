"""Sinks of media files: a Spark data source that writes each ``file`` of a table of packets from front to end.

Rows are dealt by file and sorted by ``seq``, so that a task writes one file after the other and holds one packet.  What
a head needs to know of the whole file (bytes, packets) is aggregated first and comes with the rows.  A file is written
under a name of its attempt and gets its own name when the job commits; a failed attempt leaves nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.folds import dealt
from . import containers as C
from .files import move, open_output, remove
from .media import y4m_frame_size


class Muxer:
    """Bytes ahead of the packets, for each packet, and after them; ``options`` are those of the write."""

    def __init__(self, options: dict):
        self.options = options

    def number(self, name: str, default: int | None = None) -> int:
        value = self.options.get(name, default)
        if value is None:
            raise ValueError(f"the sink needs the option {name}")
        return int(value)

    def head(self, size: int, count: int) -> bytes:
        return b""

    def packet(self, row: Row) -> bytes:
        return bytes(row.data)

    def tail(self) -> bytes:
        return b""


class WavMuxer(Muxer):
    def head(self, size: int, count: int) -> bytes:
        rate, channels, bits = self.number("rate"), self.number("channels", 1), self.number("bits", 16)
        align = channels * bits // 8
        return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", size)


class Y4mMuxer(Muxer):
    def head(self, size: int, count: int) -> bytes:
        self.colour = self.options.get("colour", "420")
        self.size = y4m_frame_size(self.number("width"), self.number("height"), self.colour)
        return f"YUV4MPEG2 W{self.number('width')} H{self.number('height')} F{self.options.get('fps', '30:1')} Ip A1:1 C{self.colour}\n".encode()

    def packet(self, row: Row) -> bytes:
        if len(row.data) != self.size:
            raise ValueError(f"a frame has {len(row.data)} bytes and not {self.size}")
        return b"FRAME\n" + bytes(row.data)


class IvfMuxer(Muxer):
    def head(self, size: int, count: int) -> bytes:
        return struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, self.options.get("fourcc", "VP80").encode(), self.number("width"), self.number("height"), self.number("fps", 30), 1, count, 0)

    def packet(self, row: Row) -> bytes:
        return struct.pack("<IQ", len(row.data), row.pts) + bytes(row.data)


class TsMuxer(Muxer):
    """Tables and cells of 188 bytes; ``kinds`` lists the streams' types."""

    def head(self, size: int, count: int) -> bytes:
        self.kinds = [int(k, 0) for k in self.options.get("kinds", "0x1B").split(",")]
        self.counters: dict[int, int] = {}
        return C.ts_tables(self.kinds, self.counters)

    def packet(self, row: Row) -> bytes:
        return C.ts_packet(C.Packet(row.stream_index, row.pts, row.dts if row.dts is not None else row.pts, row.keyframe, 0, bytes(row.data)), self.kinds, self.counters)


def element(ident: int, body: bytes) -> bytes:
    size = len(body)
    n = next(n for n in range(1, 9) if size < (1 << 7 * n) - 1)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (size | 1 << 7 * n).to_bytes(n, "big") + body


def number_element(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


class WebmMuxer(Muxer):
    """Clusters of a bounded span, number of blocks and distance that sixteen bits tell; times in milliseconds.

    ``codecs`` lists the streams' codecs (``V_VP9,A_OPUS``).  A cluster is held until it is whole.
    """

    def head(self, size: int, count: int) -> bytes:
        self.span, self.most = self.number("cluster_ms", 5000), self.number("cluster_blocks", 1000)
        self.start, self.blocks = None, []
        kind = element(0x4282, self.options.get("doctype", "webm").encode()) + number_element(0x4287, 2) + number_element(0x4285, 2)
        tracks = b""
        for n, codec in enumerate(self.options.get("codecs", "V_VP9").split(","), 1):
            video = codec.startswith("V_")
            body = number_element(0xD7, n) + number_element(0x73C5, n) + number_element(0x83, 1 if video else 2) + element(0x86, codec.encode())
            if video:
                body += element(0xE0, number_element(0xB0, self.number("width", 1)) + number_element(0xBA, self.number("height", 1)))
            tracks += element(0xAE, body)
        segment = (0x18538067).to_bytes(4, "big") + b"\x01" + b"\xff" * 7  # of unknown size
        return element(0x1A45DFA3, kind) + segment + element(0x1549A966, number_element(0x2AD7B1, 1_000_000)) + element(0x1654AE6B, tracks)

    def packet(self, row: Row) -> bytes:
        out = b""
        if self.start is not None and (row.pts - self.start > min(self.span, 32767) or row.pts < self.start or len(self.blocks) >= self.most):
            out = self.tail()
        if self.start is None:
            self.start = row.pts
        head = bytes([0x80 | row.stream_index + 1]) + struct.pack(">hB", row.pts - self.start, 0x80 if row.keyframe else 0)
        self.blocks.append(element(0xA3, head + bytes(row.data)))
        return out

    def tail(self) -> bytes:
        if self.start is None:
            return b""
        made = element(0x1F43B675, number_element(0xE7, self.start) + b"".join(self.blocks))
        self.start, self.blocks = None, []
        return made


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def annex_b(data: bytes) -> list[bytes]:
    """The units between start codes; data without any are one unit."""
    parts, at = [], data.find(b"\0\0\1")
    if at < 0:
        return [data]
    while at >= 0:
        after = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : after if after >= 0 else len(data)]
        parts.append(unit.rstrip(b"\0") if after >= 0 else unit)
        at = after
    return [p for p in parts if p]


@dataclass
class Samples:
    sizes: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    sync: list[int] = field(default_factory=list)


class Mp4Muxer(Muxer):
    """Media data in packet order, each sample a chunk, and the tables after them.

    ``kinds`` lists the streams' handlers (``vide,soun``), ``codecs`` their sample entries (``avc1,sowt``).  H.264 in
    start-code form is rewritten with lengths ahead, and its parameter sets are kept apart.  The tables hold four numbers a sample.
    """

    def head(self, size: int, count: int) -> bytes:
        self.kinds, self.codecs = self.options.get("kinds", "vide").split(","), self.options.get("codecs", "avc1").split(",")
        self.scale = self.number("timescale", 1000)
        self.samples = [Samples() for _ in self.kinds]
        self.sets: dict[int, bytes] = {}
        top = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2avc1mp41")
        # the size of rewritten data is not known ahead: each sample has a box of its own
        self.at = len(top)
        return top

    def packet(self, row: Row) -> bytes:
        t, data = self.samples[row.stream_index], bytes(row.data)
        if self.codecs[row.stream_index] == "avc1" and b"\0\0\1" in data[:4]:
            units = annex_b(data)
            self.sets |= {u[0] & 0x1F: u for u in units if u[0] & 0x1F in (7, 8)}
            data = b"".join(struct.pack(">I", len(u)) + u for u in units if u[0] & 0x1F not in (7, 8))
        t.sizes.append(len(data))
        t.places.append(self.at + 8)
        t.times.append(row.dts if row.dts is not None else row.pts)
        if row.keyframe:
            t.sync.append(len(t.sizes))
        self.at += len(data) + 8
        return box(b"mdat", data)

    def tail(self) -> bytes:
        tracks = b"".join(self._track(n, t) for n, t in enumerate(self.samples))
        return box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, self.scale, 0), bytes(80)), tracks)

    def _track(self, n: int, t: Samples) -> bytes:
        table = lambda name, rows, code: box(name, struct.pack(">II", 0, len(rows)), b"".join(struct.pack(code, *r) for r in rows))
        steps = [b - a for a, b in zip(t.times, t.times[1:], strict=False)]
        steps += [steps[-1] if steps else 1] if t.times else []
        entry = box(self.codecs[n].encode(), bytes(6), struct.pack(">H", 1), bytes(70 if self.kinds[n] == "vide" else 20), self._config() if self.codecs[n] == "avc1" else b"")
        large = self.at > 0xFFFFFFFF
        body = [
            box(b"stsd", struct.pack(">II", 0, 1), entry), table(b"stts", [(1, max(s, 0)) for s in steps], ">II"), table(b"stsc", [(1, 1, 1)] if t.sizes else [], ">III"),
            box(b"stsz", struct.pack(">III", 0, 0, len(t.sizes)), b"".join(struct.pack(">I", s) for s in t.sizes)),
            table(b"co64" if large else b"stco", [(p,) for p in t.places], ">Q" if large else ">I"), *([table(b"stss", [(s,) for s in t.sync], ">I")] if self.kinds[n] == "vide" else []),
        ]
        media = box(b"mdia", box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, self.scale, 0, 0)), box(b"hdlr", bytes(8), self.kinds[n].encode(), bytes(13)), box(b"minf", box(b"stbl", *body)))
        return box(b"trak", box(b"tkhd", struct.pack(">IIII", 7, 0, 0, n + 1), bytes(68)), media)

    def _config(self) -> bytes:
        sps, pps = self.sets.get(7, b""), self.sets.get(8, b"")
        if not sps:
            return b""
        return box(b"avcC", bytes([1, *sps[1:4].ljust(3, b"\0"), 0xFF, 0xE1]), struct.pack(">H", len(sps)), sps, bytes([1]), struct.pack(">H", len(pps)), pps)


class AviMuxer(Muxer):
    """Stream headers, the list of packets and its index, which holds sixteen bytes a packet."""

    def head(self, size: int, count: int) -> bytes:
        self.kinds = self.options.get("kinds", "vids").encode().split(b",")
        self.index, self.at = [], 4
        headers = b"".join(C.avi_list(b"strl", C.avi_chunk(b"strh", k + bytes(52))) for k in self.kinds)
        top = C.avi_list(b"hdrl", C.avi_chunk(b"avih", bytes(56)) + headers)
        # ``size`` counts data padded to even lengths
        movi = 4 + size + 8 * count
        return b"RIFF" + struct.pack("<I", 4 + len(top) + 8 + movi + 8 + 16 * count) + b"AVI " + top + b"LIST" + struct.pack("<I", movi) + b"movi"

    def packet(self, row: Row) -> bytes:
        name = b"%02d%s" % (row.stream_index, b"dc" if self.kinds[row.stream_index] == b"vids" else b"wb")
        made = C.avi_chunk(name, bytes(row.data))
        self.index.append(name + struct.pack("<III", 0x10 if row.keyframe else 0, self.at, len(row.data)))
        self.at += len(made)
        return made

    def tail(self) -> bytes:
        return C.avi_chunk(b"idx1", b"".join(self.index))


MUXERS: dict[str, type[Muxer]] = {"wav": WavMuxer, "y4m": Y4mMuxer, "ivf": IvfMuxer, "ts": TsMuxer, "avi": AviMuxer, "webm": WebmMuxer, "mkv": WebmMuxer, "mp4": Mp4Muxer}


def create_muxer(kind: str, options: dict) -> Muxer:
    """The muxer of a format; unknown ones are an error."""
    if kind not in MUXERS:
        raise ValueError(f"no sink for {kind} files")
    return MUXERS[kind](options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class MediaWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options
        create_muxer(options["kind"], options)

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        done: list[tuple[str, str]] = []
        out = muxer = now = None
        for row in iterator:
            if row.file != now:
                if out is not None:
                    out.write(muxer.tail())
                    out.close()
                now, target = row.file, f"{self.options['path']}/{row.file}"
                done.append((f"{target}.{attempt}.part", target))
                out, muxer = open_output(done[-1][0]), create_muxer(self.options["kind"], self.options)
                out.write(muxer.head(row._total, row._count))
            out.write(muxer.packet(row))
        if out is not None:
            out.write(muxer.tail())
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for part, target in (f for m in messages if m for f in m.files):
            move(part, target)

    def abort(self, messages: list[Written | None]) -> None:
        for part, _ in (f for m in messages if m for f in m.files):
            remove(part)


class MediaSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_sink"

    def schema(self) -> str:
        return "file string"

    def writer(self, schema: object, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options)


def write(packets: DataFrame, folder: str, kind: str, **options: str) -> None:
    """Write packets (``file, stream_index, seq, pts, dts, keyframe, data``) as files of a kind into a folder.

    A file that is there is replaced.  An empty table writes nothing.
    """
    create_muxer(kind, options)
    spark = packets.sparkSession
    spark.dataSource.register(MediaSink)
    size = F.octet_length("data")
    if kind == "avi":
        size = size + size % 2
    totals = packets.groupBy("file").agg(F.sum(size).cast("long").alias("_total"), F.count("*").alias("_count"))
    rows = packets.select("file", "stream_index", "seq", "pts", "dts", "keyframe", "data").join(totals, "file")
    rows = dealt(rows, "file").sortWithinPartitions("file", "seq")
    rows.write.format("media_sink").options(path=folder, kind=kind, **options).mode("append").save()
