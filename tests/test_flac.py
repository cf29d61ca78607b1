"""FLAC decoding and scans against files made by a small encoder."""

import hashlib
import io
import random

import numpy as np
import pytest

from cinelake.sources import flac, media, packet_index, streams


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> k & 1 for k in range(width - 1, -1, -1)]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def rice(self, values, k):
        for v in values:
            u = v << 1 if v >= 0 else (-v << 1) - 1
            self.unary(u >> k)
            self.put(u & (1 << k) - 1, k)

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def put_residual(w, rest, n, order, rnd):
    method, partitions = rnd.choice([0, 1]), rnd.choice([0, 0, 1, 2])
    while n % (1 << partitions) or n >> partitions <= order:
        partitions -= 1
    w.put(method, 2)
    w.put(partitions, 4)
    at = 0
    for p in range(1 << partitions):
        count = (n >> partitions) - (order if not p else 0)
        part = rest[at : at + count]
        at += count
        width, escape = (4, 15) if not method else (5, 31)
        if rnd.random() < 0.2:
            bits = max((abs(v).bit_length() + 1 for v in part), default=0) if any(part) else 0
            w.put(escape, width)
            w.put(bits, 5)
            for v in part:
                w.put(v & (1 << bits) - 1, bits)
        else:
            k = min(max(int(np.mean([abs(v) for v in part] or [0])).bit_length(), 0), escape - 1)
            w.put(k, width)
            w.rice(part, k)


def put_subframe(w, x, bits, kind, rnd):
    wasted = 0
    if rnd.random() < 0.3 and any(x):
        wasted = min((v & -v).bit_length() - 1 for v in x if v)
    code = {"constant": 0, "verbatim": 1}.get(kind)
    order = 0
    if kind.startswith("fixed"):
        order = int(kind[-1])
        code = 8 + order
    elif kind == "lpc":
        order = rnd.choice([1, 2, 5, 12, 32])
        code = 31 + order
    w.put(0, 1)
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
        x, bits = [v >> wasted for v in x], bits - wasted
    put = lambda v: w.put(v & (1 << bits) - 1, bits)
    if kind == "constant":
        put(x[0])
        return
    for v in x[:order] if kind != "verbatim" else x:
        put(v)
    if kind.startswith("fixed"):
        put_residual(w, np.diff(np.array(x, np.int64), order).tolist(), len(x), order, rnd)
    elif kind == "lpc":
        precision, shift = 8, rnd.choice([0, 5, 6])
        c = [rnd.randint(-(1 << 5), 1 << 5) // (k + 1) for k in range(order)]
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for v in c:
            w.put(v & (1 << precision) - 1, precision)
        rest = [x[t] - (sum(c[j] * x[t - 1 - j] for j in range(order)) >> shift) for t in range(order, len(x))]
        put_residual(w, rest, len(x), order, rnd)


def encode(x, block, bits, rnd, by_sample=False, stated_bits=True):
    """A whole file of samples by channel."""
    channels, n = x.shape
    frames = b""
    for number, at in enumerate(range(0, n, block)):
        part = x[:, at : at + block]
        mode = rnd.choice([None, 8, 9, 10]) if channels == 2 else None
        sub = [part[c].tolist() for c in range(channels)]
        widths = [bits] * channels
        if mode is not None:
            left, right = part
            side = left - right
            mid = (left + right) >> 1
            sub = [a.tolist() for a in {8: (left, side), 9: (side, right), 10: (mid, side)}[mode]]
            widths[0 if mode == 9 else 1] += 1
        first = at if by_sample else number
        if first < 0x80:
            coded = bytes([first])
        else:
            tail = []
            while first >= 1 << 6 - len(tail):
                tail.append(0x80 | first & 0x3F)
                first >>= 6
            coded = bytes([0x100 - (1 << 7 - len(tail)) & 0xFF | first, *reversed(tail)])
        head = bytes([0xFF, 0xF8 | by_sample, 7 << 4 | 0, (channels - 1 if mode is None else mode) << 4 | ({8: 1, 16: 4, 24: 6}[bits] if stated_bits else 0) << 1]) + coded + (part.shape[1] - 1).to_bytes(2, "big")
        w = Writer()
        for values, width in zip(sub, widths, strict=True):
            kinds = [f"fixed{k}" for k in range(5) if k < len(values)] + ["verbatim"] + (["lpc"] * 3 if len(values) > 40 else []) + (["constant"] * 9 if len(set(values)) == 1 else [])
            put_subframe(w, values, width, rnd.choice(kinds), rnd)
        frames += head + bytes([streams.crc8(head)]) + w.bytes() + b"\0\0"
    packed = 48_000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n
    info = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(flac.pcm(x, bits)).digest()
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x81\0\0\x05notes" + frames


def signal(channels, n, bits, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    top = 1 << bits - 1
    x = np.stack([(0.4 * top * np.sin(t / (9 + c)) + rng.normal(0, top / 200, n)).astype(np.int64) for c in range(channels)])
    x[:, n // 3 : n // 3 + 300] = 17
    x[:, n // 2 : n // 2 + 300] &= ~7
    return np.clip(x, -top, top - 1)


@pytest.mark.parametrize(("channels", "bits", "block"), [(1, 16, 192), (2, 16, 256), (2, 24, 300), (3, 8, 64)])
def test_decoded_samples_and_digest(spark, tmp_path, channels, bits, block):
    for seed in range(2):
        x = signal(channels, 4000 + 37 * seed, bits, seed)
        raw = encode(x, block, bits, random.Random(seed), by_sample=bool(seed), stated_bits=not seed)
        (tmp_path / f"{seed}.flac").write_bytes(raw)
        decoded = flac.read_pcm(spark, str(tmp_path / f"{seed}.flac"), range_bytes=6000)
        rows = decoded.orderBy("seq").collect()
        assert b"".join(bytes(r.data) for r in rows) == flac.pcm(x, bits)
        assert [r.pts for r in rows] == list(range(0, x.shape[1], block)) and {(r.channels, r.bits, r.rate) for r in rows} == {(channels, bits, 48_000)}
    infos = flac.read_infos(spark, str(tmp_path))
    assert sorted(r.samples for r in infos.collect()) == [4000, 4037]
    assert [r.ok for r in flac.verified(flac.read_pcm(spark, str(tmp_path)), infos).collect()] == [True, True]
    back = flac.samples_of(decoded).orderBy("channel", "i").collect()
    assert [r.x for r in back] == x.ravel().tolist()


def test_ranges_equal_one_pass(spark, tmp_path):
    raw = encode(signal(2, 6000, 16, 5), 256, 16, random.Random(5))
    (tmp_path / "a.flac").write_bytes(raw)
    whole = list(streams.parse_flac(io.BytesIO(raw)))
    for size in (3000, 1 << 20):
        got = packet_index.read(spark, str(tmp_path / "a.flac"), size).orderBy("seq").collect()
        assert [(r.pts, r.position, bytes(r.data)) for r in got] == [(p.pts, p.position, p.data) for p in whole]
    assert media.read_media(spark, str(tmp_path / "a.flac")).count() == len(whole)
    for piece in (5, 17, 4096):
        assert [at for at, _ in flac.heads(io.BytesIO(raw), 0, len(raw), piece)] == [p.position for p in whole]


def test_a_changed_sample_changes_the_digest(spark, tmp_path):
    x = signal(1, 500, 16, 9)
    raw = bytearray(encode(x, 500, 16, random.Random(1)))
    raw[26 + 8 - 4 + 4] ^= 1  # within the stated digest
    (tmp_path / "a.flac").write_bytes(bytes(raw))
    assert [r.ok for r in flac.verified(flac.read_pcm(spark, str(tmp_path)), flac.read_infos(spark, str(tmp_path))).collect()] == [False]


def test_no_flac(spark, tmp_path):
    (tmp_path / "a.flac").write_bytes(b"no such thing")
    with pytest.raises(Exception, match="no FLAC file"):
        flac.read_pcm(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no FLAC frame"):
        flac.parse_frame(b"\xff\xf8xxxx", 16)
