"""Matroska/WebM, MP4, Ogg, FLAC and MP3: packets without decoding, from files that are read piece by piece.

``parse_*`` read a file from front to end.  ``read`` gives a row per packet; what can be is read in ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .containers import Packet
from .files import listed, open_input
from .media import SCHEMA, Span

# Matroska and WebM

#: Identifiers of the elements that are read.
SEGMENT, CLUSTER, INFO, TRACKS, TRACK = 0x18538067, 0x1F43B675, 0x1549A966, 0x1654AE6B, 0xAE
TIME_SCALE, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, TRACK_NUMBER = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0xD7
EBML = 0x1A45DFA3
UNKNOWN = -1


def varint(raw: bytes, at: int = 0, keep: bool = False) -> tuple[int, int]:
    """A variable-length number and its length; with ``keep`` the length mark stays in it (identifiers)."""
    first = raw[at]
    n = 9 - first.bit_length()
    if n > 8:
        raise ValueError("a number of more than eight bytes")
    value = int.from_bytes(raw[at : at + n], "big")
    bare = value & ((1 << 7 * n) - 1)
    return (value if keep else UNKNOWN if bare == (1 << 7 * n) - 1 else bare), n


def elements(f: BinaryIO, stop: int | None) -> Iterator[tuple[int, int, int]]:
    """Identifier, begin and size of the elements from here on; whoever takes one may leave the file anywhere."""
    at = f.tell()
    while stop is None or at < stop:
        f.seek(at)
        head = f.read(12)
        if len(head) < 2:
            return
        ident, n = varint(head, 0, keep=True)
        size, m = varint(head, n)
        yield ident, at + n + m, size
        if size == UNKNOWN:  # its parts follow as if they were its neighbours
            at += n + m
        else:
            at += n + m + size


def laced(body: bytes, flags: int) -> list[bytes]:
    """The frames of a block: one, or several with their sizes ahead."""
    kind = flags >> 1 & 3
    if not kind:
        return [body]
    count, at = body[0] + 1, 1
    if kind == 2:
        size = (len(body) - 1) // count
        return [body[1 + k * size : 1 + (k + 1) * size] for k in range(count)]
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                size += body[at]
                at += 1
                if body[at - 1] < 255:
                    break
        else:
            value, n = varint(body, at)
            size = value if not k else sizes[-1] + value - ((1 << 7 * n - 1) - 1)
            at += n
        sizes.append(size)
    sizes.append(len(body) - at - sum(sizes))
    out = []
    for size in sizes:
        out.append(body[at : at + size])
        at += size
    return out


def parse_matroska(f: BinaryIO) -> Iterator[Packet]:
    """Frames in file order with times in milliseconds; a frame without a key flag is none, one in a group is one if it refers to no other."""
    scale, time, tracks = 1_000_000, 0, {}

    def block(at: int, size: int, key: bool | None) -> Iterator[Packet]:
        f.seek(at)
        raw = f.read(size)
        track, n = varint(raw)
        relative, flags = struct.unpack_from(">hB", raw, n)
        pts = (time + relative) * scale // 1_000_000
        for frame in laced(raw[n + 3 :], flags):
            yield Packet(tracks.get(track, track - 1), pts, pts, bool(flags & 0x80) if key is None else key, at, frame)

    first = True
    for ident, at, size in _flat(f, {SEGMENT, CLUSTER, INFO, TRACKS, BLOCK_GROUP}):
        if first and ident != EBML:
            raise ValueError("no Matroska file")
        first = False
        if ident in (TIME_SCALE, CLUSTER_TIME):
            f.seek(at)
            value = int.from_bytes(f.read(size), "big")
            scale, time = (value, time) if ident == TIME_SCALE else (scale, value)
        elif ident == TRACK:
            f.seek(at)
            for part, begin, length in elements(f, at + size):
                if part == TRACK_NUMBER:
                    f.seek(begin)
                    tracks[int.from_bytes(f.read(length), "big")] = len(tracks)
        elif ident == SIMPLE_BLOCK:
            yield from block(at, size, None)
        elif ident == BLOCK_GROUP:
            f.seek(at)
            parts = list(elements(f, at + size))
            for part, begin, length in parts:
                if part == BLOCK:
                    yield from block(begin, length, all(p != REFERENCE for p, _, _ in parts))


def _flat(f: BinaryIO, inside: set[int], stop: int | None = None) -> Iterator[tuple[int, int, int]]:
    """All elements, depth first; those of ``inside`` but for groups are entered."""
    for ident, at, size in elements(f, stop):
        yield ident, at, size
        if ident in inside and ident != BLOCK_GROUP and size != UNKNOWN:
            f.seek(at)
            yield from _flat(f, inside, at + size)


# MP4


@dataclass
class Track:
    number: int
    kind: str = ""
    codec: str = ""
    scale: int = 1
    sizes: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    shifts: list[int] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    sync: set[int] | None = None


def boxes(raw: bytes, at: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of the boxes in a piece of a file."""
    stop = len(raw) if stop is None else stop
    while at + 8 <= stop:
        size, name = struct.unpack_from(">I4s", raw, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        size = size or stop - at
        if size < head:
            raise ValueError("a box smaller than its head")
        yield name, at + head, min(at + size, stop)
        at += size


def movie(f: BinaryIO) -> bytes:
    """The moov box, found by hopping over the others."""
    at = 0
    while True:
        f.seek(at)
        head = f.read(16)
        if len(head) < 8:
            raise ValueError("no MP4 file with a moov box")
        size, name = struct.unpack_from(">I4s", head)
        start = 8
        if size == 1:
            size, start = struct.unpack_from(">Q", head, 8)[0], 16
        if name == b"moov":
            f.seek(at + start)
            return f.read(size - start) if size else f.read()
        if not size:
            raise ValueError("no MP4 file with a moov box")
        at += size


def tracks_of(moov: bytes) -> list[Track]:
    """The sample tables of all tracks."""
    out = []
    for name, at, end in boxes(moov):
        if name == b"trak":
            out.append(_track(moov, at, end, Track(len(out))))
    return out


def _track(raw: bytes, at: int, end: int, t: Track) -> Track:
    chunks: list[int] = []
    runs: list[tuple[int, int]] = []
    todo = [(at, end)]
    while todo:
        for name, a, z in boxes(raw, *todo.pop()):
            if name in (b"mdia", b"minf", b"stbl"):
                todo.append((a, z))
            elif name == b"mdhd":
                t.scale = struct.unpack_from(">I", raw, a + (20 if raw[a] else 12))[0]
            elif name == b"hdlr":
                t.kind = raw[a + 8 : a + 12].decode("latin-1")
            elif name == b"stsd":
                t.codec = raw[a + 12 : a + 16].decode("latin-1")
            elif name == b"stsz":
                same, n = struct.unpack_from(">II", raw, a + 4)
                t.sizes = [same] * n if same else list(struct.unpack_from(f">{n}I", raw, a + 12))
            elif name in (b"stts", b"ctts"):
                n = struct.unpack_from(">I", raw, a + 4)[0]
                pairs = struct.unpack_from(">" + ("Ii" if name == b"ctts" else "II") * n, raw, a + 8)
                flat = [v for c, v in zip(pairs[::2], pairs[1::2], strict=True) for _ in range(c)]
                t.times, t.shifts = (flat, t.shifts) if name == b"stts" else (t.times, flat)
            elif name == b"stss":
                n = struct.unpack_from(">I", raw, a + 4)[0]
                t.sync = set(struct.unpack_from(f">{n}I", raw, a + 8))
            elif name == b"stsc":
                n = struct.unpack_from(">I", raw, a + 4)[0]
                v = struct.unpack_from(f">{3 * n}I", raw, a + 8)
                runs = list(zip(v[::3], v[1::3], strict=True))
            elif name in (b"stco", b"co64"):
                n = struct.unpack_from(">I", raw, a + 4)[0]
                chunks = list(struct.unpack_from(f">{n}{'Q' if name == b'co64' else 'I'}", raw, a + 8))
    sample, run = 0, 0
    for number, place in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        for _ in range(runs[run][1] if runs else 0):
            if sample < len(t.sizes):
                t.places.append(place)
                place += t.sizes[sample]
                sample += 1
    return t


def mp4_samples(tracks: list[Track]) -> list[tuple[int, int]]:
    """Sample numbers (from 1) and tracks in reading order: the least next number first, of equals the first track."""
    return sorted((n, t.number) for t in tracks for n in range(1, len(t.places) + 1))


def parse_mp4(f: BinaryIO, first: int = 0, last: int | None = None) -> Iterator[Packet]:
    """The samples from ``first`` to before ``last`` in reading order, with the tracks' own time units."""
    tracks = tracks_of(movie(f))
    starts = []
    for t in tracks:
        total, at = 0, []
        for d in t.times:
            at.append(total)
            total += d
        starts.append(at)
    for n, number in mp4_samples(tracks)[first:last]:
        t = tracks[number]
        f.seek(t.places[n - 1])
        start = starts[number][n - 1] if n <= len(starts[number]) else 0
        yield Packet(number, start, start, t.sync is None or n in t.sync, t.places[n - 1], f.read(t.sizes[n - 1]))


# Ogg, FLAC and MP3


def parse_ogg(f: BinaryIO) -> Iterator[Packet]:
    """Packets of all logical streams; the time is the granule of the page on which a packet ends."""
    held: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    at = 0
    f.seek(0)
    while len(head := f.read(27)) == 27:
        if head[:4] != b"OggS":
            raise ValueError("no Ogg page")
        granule, serial = struct.unpack_from("<qI", head, 6)
        sizes = f.read(head[26])
        index = numbers.setdefault(serial, len(numbers))
        part = held.setdefault(serial, bytearray())
        if not head[5] & 1:
            part.clear()
        for size in sizes:
            part += f.read(size)
            if size < 255:
                yield Packet(index, granule, granule, True, at, bytes(part))
                part.clear()
        at = f.tell()


def crc8(raw: bytes) -> int:
    crc = 0
    for b in raw:
        crc ^= b
        for _ in range(8):
            crc = (crc << 1 ^ 7 if crc & 0x80 else crc << 1) & 0xFF
    return crc


def flac_head(raw: bytes, at: int) -> tuple[int, int, bool] | None:
    """Number, samples and whether the number is of a sample, of the frame whose valid head is here."""
    if len(raw) < at + 6 or raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8 or raw[at + 2] >> 4 == 0 or raw[at + 2] & 15 == 15 or raw[at + 3] & 1:
        return None
    first = raw[at + 4]
    extra = 0 if first < 0x80 else 7 - (first ^ 0xFF).bit_length()
    if first >= 0x80 and (not 1 <= extra <= 6 or any(b & 0xC0 != 0x80 for b in raw[at + 5 : at + 5 + extra])):
        return None
    number = first if first < 0x80 else first & ((1 << 6 - extra) - 1)
    for b in raw[at + 5 : at + 5 + extra]:
        number = number << 6 | b & 0x3F
    code, rate, end = raw[at + 2] >> 4, raw[at + 2] & 15, at + 5 + extra
    size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << max(code - 8, 0)
    if code in (6, 7):
        size = int.from_bytes(raw[end : end + code - 5], "big") + 1
        end += code - 5
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(raw) or crc8(raw[at:end]) != raw[end]:
        return None
    return number, size, bool(raw[at + 1] & 1)


def parse_flac(f: BinaryIO, piece: int = 1 << 20) -> Iterator[Packet]:
    """Frames between valid heads; the time is the number of the first sample."""
    f.seek(0)
    if f.read(4) != b"fLaC":
        raise ValueError("no FLAC file")
    while True:
        head = f.read(4)
        if len(head) < 4:
            return
        f.seek(int.from_bytes(head[1:], "big"), 1)
        if head[0] & 0x80:
            break
    base, raw, begin, size, at, ended = f.tell(), b"", None, 0, 0, False
    while True:
        found = raw.find(b"\xff", at)
        if found < 0 or (found + 17 > len(raw) and not ended):  # a head has up to sixteen bytes
            keep = begin if begin is not None else max(found, 0) if found >= 0 else len(raw)
            at = (found if found >= 0 else len(raw)) - keep
            more = f.read(piece)
            base, raw, begin = base + keep, raw[keep:] + more, 0 if begin is not None else None
            if not more:
                if ended:
                    break
                ended = True
            continue
        head = flac_head(raw, found)
        if head is not None:
            if begin is not None:
                yield Packet(0, pts, pts, True, base + begin, raw[begin:found])
            begin, size = found, size or head[1]
            pts = head[0] if head[2] else head[0] * size
        at = found + 1
    if begin is not None:
        yield Packet(0, pts, pts, True, base + begin, raw[begin:])


#: Kilobits a second of layer III (first version; second and later), and sample rates of the first version.
KILOBITS = ((32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
RATES = (44100, 48000, 32000)


def mp3_frame(head: bytes) -> tuple[int, int] | None:
    """Bytes and samples of the layer III frame with this head."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0 or head[1] >> 1 & 3 != 1:
        return None
    version, bits, rate = head[1] >> 3 & 3, head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or bits in (0, 15) or rate == 3:
        return None
    kilobits = KILOBITS[version != 3][bits - 1]
    hz = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    samples = 1152 if version == 3 else 576
    return samples // 8 * kilobits * 1000 // hz + (head[2] >> 1 & 1), samples


def parse_mp3(f: BinaryIO) -> Iterator[Packet]:
    """Frames one after the other, past a leading tag; what is no frame is skipped byte by byte."""
    f.seek(0)
    head = f.read(10)
    at = 10 + sum((head[9 - k] & 0x7F) << 7 * k for k in range(4)) if head[:3] == b"ID3" and len(head) == 10 else 0
    pts = 0
    while True:
        f.seek(at)
        head = f.read(4)
        if len(head) < 4:
            return
        found = mp3_frame(head)
        if found is None:
            at += 1
            continue
        data = head + f.read(found[0] - 4)
        if len(data) < found[0]:
            return
        yield Packet(0, pts, pts, True, at, data)
        at, pts = at + found[0], pts + found[1]


PARSERS: dict[str, Callable[[BinaryIO], Iterator[Packet]]] = {
    **dict.fromkeys(("mkv", "mka", "mks", "webm"), parse_matroska), **dict.fromkeys(("ogg", "oga"), parse_ogg), "flac": parse_flac, "mp3": parse_mp3,
    **dict.fromkeys(("mp4", "m4v", "m4a"), parse_mp4),
}


#: Formats whose packets are only found one after the other: a file is a partition.
IN_TURN = ("ogg", "oga", "mp3")


class PacketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Span]:
        return [Span(path, 0, 0) for path in listed(self.options["path"]) if path.rsplit(".", 1)[-1].lower() in IN_TURN] or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        with open_input(span.path) as f:
            for seq, p in enumerate(PARSERS[span.path.rsplit(".", 1)[-1].lower()](f)):
                yield (span.path, p.stream_index, seq, p.pts, p.dts, None, p.keyframe, p.position, len(p.data), p.data)


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PacketReader:
        return PacketReader(self.options)


def read(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The packets of all Matroska, MP4 and FLAC files at a path, in ranges (``packet_index``), and of Ogg and MP3 files, each in one task."""
    from . import packet_index

    spark.dataSource.register(PacketSource)
    in_turn = spark.read.format("packets").options(path=path).load()
    return packet_index.read(spark, path, kinds=("matroska", "mp4", "flac"), **options).unionByName(in_turn)


def seek(packets: DataFrame, targets: DataFrame, key: str = "stream_index") -> DataFrame:
    """For each target (the key, ``at``): ``sample``, the nearest packet's number in its stream (from 1; the earlier of
    equally near ones), and ``sync``, the last keyframe at or before it (1 if there is none).

    One sort of targets and packets together finds the neighbours on both sides; no pairs are made.
    """
    own = W.partitionBy(key).orderBy("pts", "seq")
    rows = packets.select(key, "pts", F.row_number().over(own).alias("n"), "keyframe")
    rows = rows.withColumn("_s", F.max(F.when(F.col("keyframe"), F.col("n"))).over(W.partitionBy(key).orderBy("n")))
    near = F.struct(F.col("pts").alias("pts"), F.col("n").alias("n"), F.coalesce("_s", F.lit(1)).alias("s"))
    none = F.lit(None).cast("struct<pts:bigint,n:int,s:int>")
    both = rows.select(key, F.col("pts").alias("at"), near.alias("_p"), F.lit(0).alias("_side")).unionByName(targets.select(key, F.col("at").cast("long").alias("at"), none.alias("_p"), F.lit(1).alias("_side")))
    back = W.partitionBy(key).orderBy("at", "_side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy("at", "_side").rowsBetween(0, W.unboundedFollowing)
    # of packets with one time the first counts: it has the least number
    found = both.withColumn("_b", F.last("_p", ignorenulls=True).over(back)).withColumn("_a", F.first("_p", ignorenulls=True).over(ahead)).filter("_side = 1")
    later = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_a.pts") - F.col("at") < F.col("at") - F.col("_b.pts")))
    best = F.when(later, F.col("_a")).otherwise(F.col("_b"))
    return found.select(key, "at", best["n"].alias("sample"), best["s"].alias("sync"))
