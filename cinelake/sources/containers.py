"""Container files without external decoders: IVF, MPEG-TS and AVI packets.

``parse_*`` read a file that is held whole; ``read_packets`` scans files of any size in byte ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Packet(NamedTuple):
    stream_index: int
    pts: int
    dts: int
    keyframe: bool
    position: int
    data: bytes


def write_ivf(frames: list[tuple[int, bytes]], width: int, height: int, fourcc: bytes = b"VP80", rate: tuple[int, int] = (30, 1)) -> bytes:
    """A 32-byte header, then each frame behind its size and time stamp."""
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, fourcc, width, height, rate[0], rate[1], len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(d), pts) + d for pts, d in frames)


def parse_ivf(data: bytes) -> Iterator[Packet]:
    if data[:4] != b"DKIF":
        raise ValueError("no IVF file")
    at = struct.unpack_from("<H", data, 6)[0]
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<IQ", data, at)
        frame = data[at + 12 : at + 12 + size]
        yield Packet(0, pts, pts, bool(frame) and not frame[0] & 1, at, frame)
        at += 12 + size


def has_keyframe(data: bytes) -> bool:
    """Whether an Annex-B stream holds a unit of type 5, 19 or 20."""
    at = data.find(b"\0\0\1")
    while 0 <= at < len(data) - 3:
        if data[at + 3] & 0x1F in (5, 19, 20):
            return True
        at = data.find(b"\0\0\1", at + 3)
    return False


def time33(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pack_time33(t: int, mark: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def parse_pes(raw: bytes, index: int, position: int) -> Packet | None:
    """Audio and video only; a missing time is zero, and the decoding time is by default the presentation time."""
    if len(raw) < 9 or raw[:3] != b"\0\0\1" or not 0xC0 <= raw[3] <= 0xEF:
        return None
    flags, skip = raw[7] >> 6, raw[8]
    pts = time33(raw[9:14]) if flags & 2 and skip >= 5 else 0
    dts = time33(raw[14:19]) if flags == 3 and skip >= 10 else pts
    data = raw[9 + skip :]
    return Packet(index, pts, dts, raw[3] < 0xE0 or has_keyframe(data), position, data)


def parse_ts(data: bytes, flush: bool = True) -> Iterator[Packet]:
    """Tables, then packets: one is whole when the next of its stream begins.  ``flush`` also gives the last ones."""
    program, streams, open_pes = None, {}, {}
    for at in range(0, len(data) - 187, 188):
        if data[at] != 0x47:
            raise ValueError(f"lost synchronisation at {at}")
        first, pid = bool(data[at + 1] & 0x40), (data[at + 1] & 0x1F) << 8 | data[at + 2]
        control = data[at + 3] >> 4 & 3
        body = at + 4 + (data[at + 4] + 1 if control & 2 else 0)
        payload = data[body : at + 188] if control & 1 else b""
        if pid == 0 and first:
            program = table_programs(payload)
        elif pid == program and first:
            streams = {p: i for i, p in enumerate(table_streams(payload))}
        elif pid in streams:
            if first:
                if pid in open_pes and (p := parse_pes(bytes(open_pes[pid][1]), streams[pid], open_pes[pid][0])):
                    yield p
                open_pes[pid] = (at, bytearray())
            if pid in open_pes:
                open_pes[pid][1].extend(payload)
    if flush:
        for pid, (at, raw) in sorted(open_pes.items(), key=lambda x: x[1][0]):
            if p := parse_pes(bytes(raw), streams[pid], at):
                yield p


def section(payload: bytes) -> bytes:
    start = 1 + payload[0]
    length = (payload[start + 1] & 0x0F) << 8 | payload[start + 2]
    return payload[start : start + 3 + length - 4]


def table_programs(payload: bytes) -> int | None:
    s = section(payload)
    for i in range(8, len(s) - 3, 4):
        if s[i] << 8 | s[i + 1]:
            return (s[i + 2] & 0x1F) << 8 | s[i + 3]
    return None


def table_streams(payload: bytes) -> list[int]:
    s = section(payload)
    at, out = 12 + ((s[10] & 0x0F) << 8 | s[11]), []
    while at + 5 <= len(s):
        out.append((s[at + 1] & 0x1F) << 8 | s[at + 2])
        at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    return out


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def ts_cells(pid: int, payload: bytes, counters: dict[int, int], clock: int | None = None) -> bytes:
    """A payload as cells of 188 bytes; ``counters`` go on from cell to cell of a stream."""
    out, first = b"", True
    while payload or first:
        extra = b""
        if first and clock is not None:
            extra = bytes([0x10]) + (clock << 15 | 0x3F << 9).to_bytes(6, "big")
        room = 184 - (len(extra) + 1 if extra else 0)
        part, payload = payload[:room], payload[room:]
        pad = room - len(part)
        if pad or extra:
            field = extra or (b"\0" if pad > 1 else b"")
            stuffing = 184 - len(part) - 1 - len(field)
            adaptation = bytes([len(field) + stuffing]) + field + b"\xff" * stuffing
        else:
            adaptation = b""
        n = counters.get(pid, 0)
        counters[pid] = (n + 1) % 16
        out += bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | n]) + adaptation + part
        first = False
    return out


def ts_tables(kinds: list[int], counters: dict[int, int]) -> bytes:
    """The program and stream tables; ``kinds`` are the stream types (0x1B video, 0x0F audio)."""

    def table(kind: int, body: bytes) -> bytes:
        s = bytes([kind]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0" + body
        return b"\0" + s + crc32_mpeg(s).to_bytes(4, "big")

    pids = [0x101 + i for i in range(len(kinds))]
    streams = b"".join(bytes([k]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\0" for k, p in zip(kinds, pids, strict=True))
    return ts_cells(0, table(0, b"\0\1" + (0xE000 | 0x100).to_bytes(2, "big")), counters) + ts_cells(0x100, table(2, (0xE000 | pids[0]).to_bytes(2, "big") + b"\xf0\0" + streams), counters)


def ts_packet(p: Packet, kinds: list[int], counters: dict[int, int]) -> bytes:
    code = 0xE0 if kinds[p.stream_index] == 0x1B else 0xC0
    times = pack_time33(p.pts, 2) if p.dts == p.pts else pack_time33(p.pts, 3) + pack_time33(p.dts, 1)
    head = bytes([0x80, 0x80 if len(times) == 5 else 0xC0, len(times)]) + times
    size = len(head) + len(p.data)
    return ts_cells(0x101 + p.stream_index, b"\0\0\1" + bytes([code]) + (size if size < 65536 else 0).to_bytes(2, "big") + head + p.data, counters, p.dts if p.stream_index == 0 else None)


def write_ts(packets: list[Packet], kinds: list[int]) -> bytes:
    """Tables first, then each packet."""
    counters: dict[int, int] = {}
    return ts_tables(kinds, counters) + b"".join(ts_packet(p, kinds, counters) for p in packets)


def avi_chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi_list(name: bytes, body: bytes) -> bytes:
    return avi_chunk(b"LIST", name + body)


def write_avi(packets: list[Packet], kinds: list[bytes]) -> bytes:
    """Stream headers, the movi list and its index; ``kinds`` are ``b"vids"`` or ``b"auds"``."""
    headers = b"".join(avi_list(b"strl", avi_chunk(b"strh", k + bytes(52))) for k in kinds)
    movi, index = b"", b""
    for p in packets:
        name = b"%02d%s" % (p.stream_index, b"dc" if kinds[p.stream_index] == b"vids" else b"wb")
        index += name + struct.pack("<III", 0x10 if p.keyframe else 0, 4 + len(movi), len(p.data))
        movi += avi_chunk(name, p.data)
    body = avi_list(b"hdrl", avi_chunk(b"avih", bytes(56)) + headers) + avi_list(b"movi", movi) + avi_chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def parse_avi(data: bytes) -> Iterator[Packet]:
    """Packets by the index, else by walking the movi list; times count the packets of each stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index, counts = 12, None, b"", {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None:
        return
    entries = [(*struct.unpack_from("<4sIII", index, i),) for i in range(0, len(index) - 15, 16)] if index else walk_movi(data, *movi)
    for name, flags, offset, size in entries:
        if name[:2].isdigit():
            n, start = int(name[:2]), movi[0] + offset + 8
            counts[n] = counts.get(n, -1) + 1
            yield Packet(n, counts[n], counts[n], bool(flags & 0x10), start, data[start : start + size])


def walk_movi(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int, int]]:
    at = start + 4
    while at + 8 <= stop:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        yield name, 0x10 if name[2:] == b"wb" or has_keyframe(body) else 0, at - start, size
        at += 8 + size + size % 2


PARSERS = {"ivf": parse_ivf, "ts": parse_ts, "m2ts": parse_ts, "avi": parse_avi}


def read_packets(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The packets of all containers at a path or glob, by extension, in byte ranges (see ``packet_index``)."""
    from . import packet_index

    return packet_index.read(spark, path, **options)


def amf0(value: object) -> bytes:
    """Tagged binary values: numbers, booleans, strings, null, maps and lists."""
    if value is None:
        return b"\x05"
    if isinstance(value, bool):
        return b"\x01" + bytes([value])
    if isinstance(value, int | float):
        return b"\x00" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\x02" + struct.pack(">H", len(raw)) + raw if len(raw) < 65536 else b"\x0c" + struct.pack(">I", len(raw)) + raw
    if isinstance(value, dict):
        return b"\x03" + b"".join(amf0(str(k))[1:] + amf0(v) for k, v in value.items()) + b"\0\0\x09"
    if isinstance(value, list):
        return b"\x0a" + struct.pack(">I", len(value)) + b"".join(map(amf0, value))
    raise TypeError(f"no tag for {type(value).__name__}")
