"""Units of H.264 streams: found behind start codes or lengths, with what their heads say.

``units`` gives a row per unit of each packet.  Numbers in unit bodies are Exp-Golomb coded; the bytes that keep start
codes out of them are taken away first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = "file string, stream_index int, seq bigint, unit int, position int, size int, ref_idc int, type int, first_macroblock bigint, slice_type int, parameter_set int"
#: Types of units that hold slices, and of parameter sets.
SLICES, SEQUENCE_SET, PICTURE_SET = (1, 2, 5), 7, 8
#: Profiles whose sequence sets tell the chroma format.
HIGH_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128)


class BitReader:
    """Bits of a unit's body, from its first byte on."""

    def __init__(self, body: bytes):
        self.value, self.left = int.from_bytes(body, "big"), len(body) * 8

    def bits(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the unit ends within a number")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def unsigned(self) -> int:
        """As many zeros as there are bits behind the next one."""
        rest = self.value & (1 << self.left) - 1
        zeros = self.left - rest.bit_length()
        if 2 * zeros + 1 > self.left:
            raise ValueError("the unit ends within a number")
        self.left -= zeros
        return self.bits(zeros + 1) - 1

    def signed(self) -> int:
        """1, -1, 2, -2 and so on, by the unsigned number."""
        n = self.unsigned()
        return (n + 1) // 2 if n % 2 else -(n // 2)


def unescaped(body: bytes) -> bytes:
    """Without the threes behind pairs of zero bytes."""
    parts, at = [], 0
    found = body.find(b"\0\0\3")
    while found >= 0:
        parts.append(body[at : found + 2])
        at = found + 3
        found = body.find(b"\0\0\3", at)
    return b"".join([*parts, body[at:]])


def behind_start_codes(data: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of the units between start codes; zeros before a code belong to it."""
    at = data.find(b"\0\0\1")
    while at >= 0:
        after = data.find(b"\0\0\1", at + 3)
        end = after if after >= 0 else len(data)
        while after >= 0 and end > at + 3 and not data[end - 1]:
            end -= 1
        if end > at + 3:
            yield at + 3, end
        at = after


def behind_lengths(data: bytes, width: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at + width <= len(data):
        size = int.from_bytes(data[at : at + width], "big")
        at += width
        if size:
            yield at, min(at + size, len(data))
        at += size


def slice_head(body: bytes) -> tuple[int, int, int] | tuple[None, None, None]:
    """First macroblock, type and picture set of a slice, whose first bytes are enough; none of a broken one."""
    r = BitReader(unescaped(body[:24]))
    try:
        return r.unsigned(), r.unsigned(), r.unsigned()
    except ValueError:
        return None, None, None


def units(packets: DataFrame, lengths: int = 0) -> DataFrame:
    """The units of packets (``file, stream_index, seq, data``): behind start codes, or behind lengths of so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, stream, seq, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                spans = behind_lengths(data or b"", lengths) if lengths else behind_start_codes(data or b"")
                for n, (i, j) in enumerate(spans):
                    kind = data[i] & 0x1F
                    head = slice_head(data[i + 1 : j]) if kind in SLICES else (None, None, set_number(kind, data[i + 1 : j]))
                    rows.append((file, stream, seq, n, i, j - i, data[i] >> 5 & 3, kind, *head))
            types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in UNITS.split(", ")])

    return packets.select("file", F.col("stream_index").cast("int").alias("stream_index"), F.col("seq").cast("long").alias("seq"), "data").mapInArrow(run, UNITS)


def set_number(kind: int, body: bytes) -> int | None:
    """The number of a parameter set (none of other units)."""
    if kind not in (SEQUENCE_SET, PICTURE_SET):
        return None
    r = BitReader(unescaped(body[:24]))
    try:
        if kind == SEQUENCE_SET:
            r.bits(24)  # profile, constraints and level
        return r.unsigned()
    except ValueError:
        return None


def sequence_set(body: bytes) -> dict[str, int]:
    """Profile, level, number and size in pixels of a sequence set (without its first byte)."""
    r = BitReader(unescaped(body))
    profile, _, level, number = r.bits(8), r.bits(8), r.bits(8), r.unsigned()
    chroma = 1
    if profile in HIGH_PROFILES:
        chroma = r.unsigned()
        if chroma == 3:
            r.bits(1)
        r.unsigned(), r.unsigned(), r.bits(1)
        if r.bits(1):
            for k in range(8 if chroma != 3 else 12):
                if r.bits(1):
                    last = following = 8
                    for _ in range(16 if k < 6 else 64):
                        if following:
                            following = (last + r.signed()) % 256
                        last = following or last
    r.unsigned()
    order = r.unsigned()
    if order == 0:
        r.unsigned()
    elif order == 1:
        r.bits(1), r.signed(), r.signed()
        for _ in range(r.unsigned()):
            r.signed()
    r.unsigned(), r.bits(1)
    across, down = r.unsigned() + 1, r.unsigned() + 1
    whole = r.bits(1)  # frames and no fields
    if not whole:
        r.bits(1)
    r.bits(1)
    crop = [r.unsigned() for _ in range(4)] if r.bits(1) else [0] * 4
    step_x, step_y = (2 if chroma in (1, 2) else 1), (2 if chroma == 1 else 1) * (2 - whole)
    return {"profile": profile, "level": level, "number": number, "width": 16 * across - step_x * (crop[0] + crop[1]), "height": 16 * down * (2 - whole) - step_y * (crop[2] + crop[3])}


def keyframes(found: DataFrame) -> DataFrame:
    """``file, stream_index, seq, keyframe``: whether a packet holds a unit of type 5, 19 or 20."""
    return found.groupBy("file", "stream_index", "seq").agg(F.max(F.col("type").isin(5, 19, 20)).alias("keyframe"))
