"""WAV and Y4M files: Python data sources with ranged partitions, and header readers.

``spark.read.format("wav")`` gives a packet per second of audio, ``"y4m"`` a packet per frame; both read byte ranges
of fixed-size records, so that any packet is found without scanning what precedes it.  The options ``path`` (a file or
a glob, on a file system or store that all executors reach) and ``packets_per_partition`` apply.  Small files are read
whole, many in a task, and their headers only there; ``tasks`` is how many can run at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from .files import open_input, size_of, sized

SCHEMA = "file string, stream_index int, seq bigint, pts bigint, dts bigint, duration bigint, keyframe boolean, position bigint, size int, data binary"


@dataclass
class WavHeader:
    channels: int
    rate: int
    bits: int
    align: int
    data_start: int
    data_size: int


def wav_header(path: str) -> WavHeader:
    """Walk the RIFF chunks up to the data chunk."""
    with open_input(path) as f:
        if (head := f.read(12))[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise ValueError(f"{path} is no RIFF/WAVE file")
        fmt = None
        while len(chunk := f.read(8)) == 8:
            name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
            if name == b"fmt ":
                _, channels, rate, _, align, bits = struct.unpack("<HHIIHH", f.read(size)[:16])
                fmt = (channels, rate, bits, align)
            elif name == b"data":
                if fmt is None:
                    break
                return WavHeader(*fmt, f.tell(), size)
            else:
                f.seek(size + size % 2, 1)
    raise ValueError(f"{path} has no fmt and data chunks")


@dataclass
class Y4mHeader:
    width: int
    height: int
    rate: tuple[int, int]
    colour: str
    start: int
    frame_size: int


def y4m_frame_size(width: int, height: int, colour: str) -> int:
    """Bytes of a frame by chroma format, doubled beyond eight bits."""
    w, h = (width + 1) // 2, (height + 1) // 2
    luma = width * height
    size = {"420": luma + 2 * w * h, "422": luma + 2 * w * height, "444": 3 * luma, "mono": luma}.get(colour[:4] if colour.startswith("mono") else colour[:3])
    if size is None:
        raise ValueError(f"unknown chroma format {colour}")
    return size * (2 if colour.endswith(("p10", "p12")) else 1)


def y4m_header(path: str) -> Y4mHeader:
    with open_input(path) as f:
        line = f.read(256).split(b"\n")[0] + b"\n"
        words = line.decode("ascii").split()
        if not words or words[0] != "YUV4MPEG2":
            raise ValueError(f"{path} is no YUV4MPEG2 file")
        tags = {w[0]: w[1:] for w in words[1:]}
        num, den = (int(x) for x in tags.get("F", "25:1").split(":"))
        width, height, colour = int(tags["W"]), int(tags["H"]), tags.get("C", "420")
        return Y4mHeader(width, height, (num, den), colour, len(line), y4m_frame_size(width, height, colour))


@dataclass
class Span(InputPartition):
    """Packets of a file; without ``last`` all from the first on."""

    path: str
    first: int
    last: int | None


@dataclass
class Spans(InputPartition):
    spans: list[Span]


#: Bytes up to which a file is small, and bytes and number of small files that a task reads.
SMALL, TASK_BYTES, TASK_FILES = 4 << 20, 32 << 20, 1000


class MediaReader(DataSourceReader):
    """Ranges of packets as partitions; comparisons of ``seq`` with constants narrow the ranges."""

    def __init__(self, options: dict):
        self.options, self.low, self.high = options, 0, None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  the interface's name
        for f in filters:
            if f.attribute == ("seq",) and isinstance(f, EqualTo | GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            if f.attribute == ("seq",) and isinstance(f, EqualTo | LessThanOrEqual):
                self.high = f.value if self.high is None else min(self.high, f.value)
            if f.attribute != ("seq",) or not isinstance(f, EqualTo | GreaterThanOrEqual | LessThanOrEqual):
                yield f

    def partitions(self) -> list[Spans]:
        asked = self.options.get("packets_per_partition")
        size, small = int(asked or 64), -1 if asked else SMALL
        files = sized(self.options["path"])
        most = max(min(-(-len(files) // int(self.options.get("tasks", 8))), TASK_FILES), 1)
        parts, held, weight = [], [], 0
        for path, length in files:
            if length > small:
                stop = self.stop(path, None)
                parts += [Spans([Span(path, i, min(i + size, stop))]) for i in range(self.low, stop, size)]
                continue
            if held and (len(held) == most or weight + length > TASK_BYTES):
                parts.append(Spans(held))
                held, weight = [], 0
            held.append(Span(path, self.low, None))
            weight += length
        return [*parts, Spans(held)] if held or not parts else parts

    def stop(self, path: str, last: int | None) -> int:
        """Where a file's packets end, by its header unless that is known, or by the filters."""
        stop = self.count(path) if last is None else last
        return stop if self.high is None else min(stop, self.high + 1)

    def read(self, part: Spans) -> Iterator[tuple]:
        for s in part.spans:
            yield from self.packets(Span(s.path, s.first, self.stop(s.path, s.last)))


class WavReader(MediaReader):
    def count(self, path: str) -> int:
        h = wav_header(path)
        return -(-h.data_size // (h.rate * h.align))

    def packets(self, span: Span) -> Iterator[tuple]:
        h = wav_header(span.path)
        with open_input(span.path) as f:
            for seq in range(span.first, span.last):
                at = h.data_start + seq * h.rate * h.align
                f.seek(at)
                data = f.read(min(h.rate * h.align, h.data_start + h.data_size - at))
                yield (span.path, 0, seq, seq * h.rate, seq * h.rate, len(data) // h.align, True, at, len(data), data)


class Y4mReader(MediaReader):
    def count(self, path: str) -> int:
        h = y4m_header(path)
        return (size_of(path) - h.start) // (h.frame_size + 6)

    def packets(self, span: Span) -> Iterator[tuple]:
        h = y4m_header(span.path)
        with open_input(span.path) as f:
            for seq in range(span.first, span.last):
                at = h.start + seq * (h.frame_size + 6)
                f.seek(at)
                if f.read(6) != b"FRAME\n":
                    raise ValueError(f"{span.path}: frame {seq} has parameters of its own")
                data = f.read(h.frame_size)
                yield (span.path, 0, seq, seq, seq, 1, False, at, len(data), data)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WavReader:
        return WavReader(self.options)


class Y4mSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Y4mReader:
        return Y4mReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known; they take filters, which Spark passes to Python sources only if told so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
    spark.dataSource.register(Y4mSource)


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Open by the lower-cased extension; unknown ones are an error."""
    from . import packet_index, streams

    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("wav", "y4m"):
        register(spark)
        options = {"tasks": str(spark.sparkContext.defaultParallelism)} | options
        return spark.read.format(kind).options(path=path, **options).load()
    if kind in packet_index.KINDS:
        return packet_index.read(spark, path, **{k: int(v) for k, v in options.items()})
    if kind in streams.IN_TURN:
        return streams.read(spark, path)
    raise ValueError(f"no reader for .{kind} files")
