"""FLAC: splittable scans and exact decoding.

Frames stand alone: they are found by their heads in any byte range (``packet_index``), and decoded task by task.  A frame's
bits are unpacked once; the ends of Rice codes are hopped along and their values gathered at once, fixed predictors are
running sums, and the linear predictors of many frames are undone side by side, a time step for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_input
from .streams import flac_head


class StreamInfo(NamedTuple):
    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes


def stream_info(f: BinaryIO) -> tuple[StreamInfo | None, int]:
    """What the file says of itself (none if it lacks that block), and where its first frame stands."""
    f.seek(0)
    if f.read(4) != b"fLaC":
        raise ValueError("no FLAC file")
    info = None
    while True:
        head = f.read(4)
        if len(head) < 4:
            return info, f.tell()
        size = int.from_bytes(head[1:], "big")
        if head[0] & 0x7F == 0 and size >= 34:
            raw = f.read(size)
            packed = int.from_bytes(raw[10:18], "big")
            info = StreamInfo(int.from_bytes(raw[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), raw[18:34])
        else:
            f.seek(size, 1)
        if head[0] & 0x80:
            return info, f.tell()


def heads(f: BinaryIO, at: int, length: int, piece: int = 1 << 20) -> Iterator[tuple[int, tuple[int, int, bool]]]:
    """Places and contents of the valid frame heads from ``at`` on; each is told by its own bytes."""
    while at < length:
        f.seek(at)
        raw = f.read(piece + 16)  # a head has up to sixteen bytes
        place = raw.find(b"\xff", 0, piece)
        while place >= 0:
            head = flac_head(raw, place)
            if head is not None:
                yield at + place, head
            place = raw.find(b"\xff", place + 1, piece)
        at += piece


@dataclass
class Subframe:
    samples: np.ndarray  # what is known; residuals where a predictor is to be undone
    order: int = 0
    coefficients: np.ndarray | None = None
    shift: int = 0
    wasted: int = 0


class Bits:
    """A frame's bits, and for each place that of the next one that is set."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        n = len(self.bits)
        places = np.where(self.bits, np.arange(n), n)
        self.next = np.minimum.accumulate(places[::-1])[::-1].tolist()
        self.at = 0

    def number(self, width: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + width].tolist():
            value = value << 1 | b
        self.at += width
        return value

    def signed(self, width: int) -> int:
        value = self.number(width)
        return value - (1 << width) if width and value >> width - 1 else value

    def many(self, count: int, width: int) -> np.ndarray:
        """Signed numbers of one width."""
        if not width:
            return np.zeros(count, np.int64)
        rows = self.bits[self.at : self.at + count * width].reshape(count, width).astype(np.int64)
        self.at += count * width
        values = rows @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return np.where(rows[:, 0] == 1, values - (1 << width), values)

    def unary(self) -> int:
        zeros = self.next[self.at] - self.at
        self.at += zeros + 1
        return zeros

    def rice(self, count: int, k: int) -> np.ndarray:
        starts, stops, at, following = [0] * count, [0] * count, self.at, self.next
        for n in range(count):
            starts[n] = at
            stop = following[at]
            stops[n] = stop
            at = stop + 1 + k
        self.at = at
        ends = np.array(stops, np.int64)
        values = ends - np.array(starts, np.int64)
        if k:
            rest = self.bits[ends[:, None] + 1 + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
            values = values << k | rest
        return values >> 1 ^ -(values & 1)


def residual(b: Bits, count: int, order: int) -> np.ndarray:
    method = b.number(2)
    if method > 1:
        raise ValueError("reserved coding of residuals")
    width, escape = (4, 15) if not method else (5, 31)
    partitions = 1 << b.number(4)
    out = []
    for p in range(partitions):
        n = count // partitions - (order if not p else 0)
        k = b.number(width)
        out.append(b.rice(n, k) if k != escape else b.many(n, b.number(5)))
    return np.concatenate(out)


#: The predictors of order 0 to 4 as differences; undone by as many running sums.
def undo_differences(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    order = len(first)
    out = rest
    for k in range(order, 0, -1):  # the k-th differences, from the value of the (k-1)-th ones before them
        start = np.diff(first, k - 1)[-1] if order else 0
        out = start + np.cumsum(out)
    return np.concatenate([first, out])


def subframe(b: Bits, n: int, bits: int) -> Subframe:
    if b.number(1):
        raise ValueError("no subframe here")
    kind = b.number(6)
    wasted = b.unary() + 1 if b.number(1) else 0
    bits -= wasted
    if kind == 0:
        return Subframe(np.full(n, b.signed(bits), np.int64), wasted=wasted)
    if kind == 1:
        return Subframe(b.many(n, bits), wasted=wasted)
    if 8 <= kind <= 12:
        first = b.many(kind & 7, bits)
        return Subframe(undo_differences(first, residual(b, n, kind & 7)), wasted=wasted)
    if kind >= 32:
        order = (kind & 31) + 1
        first = b.many(order, bits)
        precision, shift = b.number(4) + 1, b.signed(5)
        coefficients = b.many(order, precision)
        return Subframe(np.concatenate([first, residual(b, n, order)]), order, coefficients, max(shift, 0), wasted)
    raise ValueError("reserved subframe")


def undo_predictors(frames: list[Subframe]) -> None:
    """Put samples in the place of residuals, in all subframes of one length side by side."""
    by_length: dict[int, list[Subframe]] = {}
    for s in frames:
        if s.order:
            by_length.setdefault(len(s.samples), []).append(s)
    for n, group in by_length.items():
        most = max(s.order for s in group)
        known = np.zeros((len(group), most + n), np.int64)
        weights = np.zeros((len(group), most), np.int64)
        order, shift = np.array([s.order for s in group]), np.array([s.shift for s in group], np.int64)
        for k, s in enumerate(group):
            known[k, most:] = s.samples
            weights[k, most - s.order :] = s.coefficients[::-1]
        for t in range(int(order.min()), n):
            predicted = (weights * known[:, t : t + most]).sum(axis=1) >> shift
            known[:, most + t] += np.where(order <= t, predicted, 0)
        for k, s in enumerate(group):
            s.samples, s.order = known[k, most:], 0


#: Bits of a sample by their code (0: as the file says).
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


@dataclass
class Frame:
    channels: list[Subframe]
    assignment: int
    bits: int


def parse_frame(raw: bytes, file_bits: int) -> Frame:
    head = flac_head(raw, 0)
    if head is None:
        raise ValueError("no FLAC frame")
    n, assignment = head[1], raw[3] >> 4
    bits = SAMPLE_BITS.get(raw[3] >> 1 & 7, file_bits)
    number = 1 if raw[4] < 0x80 else 8 - (raw[4] ^ 0xFF).bit_length()
    size = 4 + number + {6: 1, 7: 2}.get(raw[2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(raw[2] & 15, 0) + 1
    b = Bits(raw[size:])
    count = assignment + 1 if assignment < 8 else 2
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(assignment)
    return Frame([subframe(b, n, bits + (c == side)) for c in range(count)], assignment, bits)


def channels_of(f: Frame) -> np.ndarray:
    """Samples by channel, with both channels of a pair put together again."""
    c = [s.samples << s.wasted for s in f.channels]
    if f.assignment == LEFT_SIDE:
        c[1] = c[0] - c[1]
    elif f.assignment == SIDE_RIGHT:
        c[0] = c[0] + c[1]
    elif f.assignment == MID_SIDE:
        mid = c[0] << 1 | c[1] & 1
        c = [mid + c[1] >> 1, mid - c[1] >> 1]
    return np.stack(c)


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian bytes, as many per sample as the bits take."""
    width = (bits + 7) // 8
    flat = np.ascontiguousarray(samples.T).astype("<i4").view(np.uint8).reshape(-1, 4)
    return flat[:, :width].tobytes()


#: Frames whose predictors are undone side by side.
TOGETHER = 64
DECODED = "file string, seq bigint, pts bigint, rate int, channels int, bits int, samples int, data binary"


def decode(packets: DataFrame, infos: DataFrame) -> DataFrame:
    """Frames (``file, seq, pts, data``) as interleaved PCM; ``infos`` has a row per file, for what its frames leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, TOGETHER):
                rows = b.slice(start, TOGETHER).to_pylist()
                frames = [parse_frame(r["data"], r["bits"]) for r in rows]
                undo_predictors([s for f in frames for s in f.channels])
                made = [channels_of(f) for f in frames]
                columns = [[r["file"] for r in rows], [r["seq"] for r in rows], [r["pts"] for r in rows], [r["rate"] for r in rows], [len(m) for m in made], [f.bits for f in frames], [m.shape[1] for m in made], [pcm(m, f.bits) for m, f in zip(made, frames, strict=True)]]
                types = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in DECODED.split(", ")])

    known = infos.select("file", "rate", "bits")
    return packets.select("file", "seq", "pts", "data").join(known, "file").mapInArrow(run, DECODED)


INFO = "file string, block int, rate int, channels int, bits int, samples bigint, md5 binary"


def read_infos(spark: SparkSession, path: str) -> DataFrame:
    """What each FLAC file at a path or glob says of itself."""
    from .packet_index import files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file in b.column(0).to_pylist():
                with open_input(file) as f:
                    info = stream_info(f)[0]
                if info is None:
                    raise ValueError(f"{file} has no stream information")
                rows.append((file, *info))
            types = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in INFO.split(", ")])

    return files(spark, path).filter("kind = 'flac'").select("file").mapInArrow(run, INFO)


def read_pcm(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The decoded frames of all FLAC files at a path or glob; a file is decoded in as many tasks as it has byte ranges."""
    from .packet_index import read

    return decode(read(spark, path, kinds=("flac",), **options), read_infos(spark, path))


def samples_of(decoded: DataFrame) -> DataFrame:
    """``file, channel, i, x``: a row per sample of decoded frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                width = (r["bits"] + 7) // 8
                raw = np.frombuffer(r["data"], np.uint8).reshape(-1, width)
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw
                x = (wide.view("<i4").ravel() >> 8 * (4 - width)).reshape(r["samples"], r["channels"])
                for c in range(r["channels"]):
                    n = r["samples"]
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n, pa.string()), pa.array(np.full(n, c, np.int32)), pa.array(np.arange(r["pts"], r["pts"] + n)), pa.array(x[:, c].astype(np.int32))], ["file", "channel", "i", "x"])

    return decoded.select("file", "pts", "channels", "bits", "samples", "data").mapInArrow(run, "file string, channel int, i bigint, x int")


def digests(decoded: DataFrame) -> DataFrame:
    """``file, md5``: the digest of each file's samples, by a pass over its frames in order."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, digest = None, hashlib.md5()
        for b in batches:
            for own, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != file:
                    if file is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()])], ["file", "md5"])
                    file, digest = own, hashlib.md5()
                digest.update(data)
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()])], ["file", "md5"])

    return decoded.select("file", "seq", "data").repartition("file").sortWithinPartitions("file", "seq").mapInArrow(run, "file string, md5 string")


def verified(decoded: DataFrame, infos: DataFrame) -> DataFrame:
    """``file, ok``: whether the decoded samples of each file have the digest that it states."""
    return digests(decoded).join(infos.select("file", F.lower(F.hex("md5")).alias("_stated")), "file").select("file", (F.col("md5") == F.col("_stated")).alias("ok"))
