"""Motion interpolation, block transforms, units, hash neighbours, dither and frame history, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators import blocks, interpolation, nal, neighbours, pixels, video

FRAMES = "stream long, frame_no long, width int, height int, data binary"


def plain_motion(a, b, block, reach):
    h, w = a.shape
    out = {}
    for by in range(0, h, block):
        for bx in range(0, w, block):
            best = None
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    cost = sum(abs(int(a[y, x]) - int(b[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)])) for y in range(by, min(by + block, h)) for x in range(bx, min(bx + block, w)))
                    if best is None or cost < best[0]:
                        best = (cost, dx, dy)
            out[by // block, bx // block] = best[1:]
    return out


def test_motion_equals_plain_search():
    rng = np.random.default_rng(1)
    for h, w, block, reach in ((13, 10, 4, 3), (8, 8, 16, 2), (5, 9, 3, 1)):
        a = rng.integers(0, 256, (h, w), dtype=np.uint8)
        b = np.roll(a, (1, 2), (0, 1)) if h == 13 else rng.integers(0, 4, (h, w), dtype=np.uint8)
        dx, dy = interpolation.motion_of(a, b, block, reach)
        assert {(j, i): (dx[j, i], dy[j, i]) for j in range(dx.shape[0]) for i in range(dx.shape[1])} == plain_motion(a, b, block, reach)


def picture(x, y, size=32):
    luma = np.full((size, size), 20, np.uint8)
    luma[y : y + 8, x : x + 8] = np.arange(64, dtype=np.uint8).reshape(8, 8) + 150
    return luma.tobytes() + bytes([100]) * (size * size // 2)


def test_a_moved_square_lands_between(spark):
    rows = [(0, n, 32, 32, bytearray(picture(8 + 4 * n, 8))) for n in range(5)] + [(1, 0, 32, 32, bytearray(picture(3, 3)))]
    frames = spark.createDataFrame(rows, FRAMES)
    for stretch in (2, 256):
        made = {(r.stream, r.frame_no): bytes(r.data) for r in interpolation.slow_motion(frames, 0.5, 8, 8, stretch).collect()}
        assert set(made) == {(0, k) for k in range(10)} | {(1, 0), (1, 1)}
        for n in range(5):
            assert made[0, 2 * n] == rows[n][4]
        for n in range(4):
            a, b = (np.frombuffer(rows[n + k][4], np.uint8, 1024).reshape(32, 32) for k in (0, 1))
            motion = plain_motion(a, b, 8, 8)
            want = np.empty((32, 32), np.uint8)
            for y in range(32):
                for x in range(32):
                    dx, dy = (int(v * 0.5) for v in motion[y // 8, x // 8])
                    want[y, x] = int(0.5 * a[y, x] + 0.5 * b[min(max(y + dy, 0), 31), min(max(x + dx, 0), 31)])
            assert np.frombuffer(made[0, 2 * n + 1], np.uint8, 1024).tobytes() == want.tobytes()
            x = 8 + 4 * n
            if x % 8 == 0:  # the block that holds the square has moved by half of its way
                assert (want[8:16, x : x + 8].astype(int) >= 85).all()
        assert made[0, 9] == rows[4][4] and made[1, 1] == rows[5][4]
    with pytest.raises(ValueError):
        interpolation.slow_motion(frames, 0)


def plain_butterfly(x):
    s, d = [x[k] + x[7 - k] for k in range(4)], [x[k] - x[7 - k] for k in range(4)]
    w4, wo, w6 = (lambda v: v * 46341 >> 16), (lambda v: v * 39200 >> 16), (lambda v: v * 35468 >> 15)
    e = [s[0] + s[3], s[0] - s[3], s[1] + s[2], s[1] - s[2]]
    return [e[0] + e[2], d[0] + w4(d[3]) + wo(d[2]), e[1] + w6(e[3]), d[0] - w4(d[3]) - wo(d[2]), e[0] - e[2], d[1] + wo(d[3]) - w4(d[2]), e[1] - w6(e[3]), d[1] - wo(d[3]) + w4(d[2])]


def test_block_transform(spark):
    rng = np.random.default_rng(4)
    stack = rng.integers(0, 256, (6, 8, 8))
    got = blocks.forward(stack)
    for block, out in zip(stack - 128, got, strict=True):
        rows = [plain_butterfly(r) for r in block.tolist()]
        columns = [plain_butterfly([r[k] for r in rows]) for k in range(8)]
        assert out.tolist() == [[columns[j][i] + 4 >> 3 for j in range(8)] for i in range(8)]
    flat = blocks.forward(np.full((8, 8), 200))
    assert flat[0, 0] == 8 * (200 - 128) and not flat.ravel()[1:].any()
    assert blocks.forward(np.full((8, 8), 512), 10).tolist() == np.zeros((8, 8)).tolist()
    matrix = rng.integers(0, 40, (8, 8))
    for scale in (0, 1, 9):
        made = blocks.quantised(got, matrix, scale)
        for c, q in zip(got.reshape(-1, 64).tolist(), made.reshape(-1, 64).tolist(), strict=True):
            for k in range(64):
                by = scale * 16 if not k else max(int(matrix.ravel()[k]), 1) * 16
                v = c[k] * scale
                assert q[k] == (c[k] if not by else (abs(v) + by // 2) // by * (1 if v >= 0 else -1))
    plane = rng.integers(0, 256, (10, 19), dtype=np.uint8)
    cut = blocks.blocks_of(plane)
    assert cut.shape == (6, 8, 8) and cut[1].tolist() == plane[:8, 8:16].tolist() and cut[5, 1, 2] == plane[9, 18] == cut[5, 7, 7]
    frame = [(0, 0, 16, 8, bytearray(range(128)) + bytearray(64))]
    out = blocks.luma_blocks(spark.createDataFrame(frame, FRAMES)).orderBy("block").collect()
    assert [r.coefficients for r in out] == blocks.forward(blocks.blocks_of(np.arange(128, dtype=np.uint8).reshape(8, 16))).reshape(2, 64).tolist()


class BitWriter:
    def __init__(self):
        self.text = ""

    def bits(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def unsigned(self, value):
        body = format(value + 1, "b")
        self.text += "0" * (len(body) - 1) + body

    def signed(self, value):
        self.unsigned(2 * value - 1 if value > 0 else -2 * value)

    def body(self):
        text = self.text + "1"
        raw = int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big")
        out, zeros = bytearray(), 0
        for b in raw:
            if zeros == 2 and b <= 3:
                out.append(3)
                zeros = 0
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        return bytes(out)


def test_units_and_numbers(spark):
    w, numbers = BitWriter(), [0, 1, 2, 7, 8, 255, 65536, 2**20]
    for n in numbers:
        w.unsigned(n)
        w.signed(n)
        w.signed(-n)
    r = nal.BitReader(nal.unescaped(w.body()))
    for n in numbers:
        assert (r.unsigned(), r.signed(), r.signed()) == (n, n, -n)
    head = BitWriter()
    head.unsigned(70000), head.unsigned(7), head.unsigned(3)
    one = bytes([0x65]) + head.body() + b"rest of it"
    data = b"\0\0\0\1\x67\x42\0\x1e\xf4" + b"\0\0\1\x68\xce" + b"\0\0\0\1" + one + b"\0\0\1" + b"\0\0\1\x09\xf0\0\0"
    packets = spark.createDataFrame([("a", 0, 4, bytearray(data)), ("a", 0, 5, bytearray(b"\0\0\1\x41\x9a")), ("a", 0, 6, None), ("a", 1, 0, bytearray(b"none"))], "file string, stream_index int, seq long, data binary")
    rows = nal.units(packets).orderBy("seq", "unit").collect()
    assert [(r.seq, r.unit, r.type, r.ref_idc, r.size) for r in rows] == [(4, 0, 7, 3, 5), (4, 1, 8, 3, 2), (4, 2, 5, 3, len(one)), (4, 3, 9, 0, 4), (5, 0, 1, 2, 2)]
    assert (rows[2].first_macroblock, rows[2].slice_type, rows[2].parameter_set) == (70000, 7, 3)
    assert all(data[r.position : r.position + r.size][0] & 0x1F == r.type for r in rows[:4])
    keys = {(r.stream_index, r.seq): r.keyframe for r in nal.keyframes(nal.units(packets)).collect()}
    assert keys == {(0, 4): True, (0, 5): False}
    assert nal.slice_head(b"\0\0") == (None, None, None)
    sized = b"".join(len(u).to_bytes(4, "big") + u for u in (one, b"\x41\x9a", b""))
    again = nal.units(spark.createDataFrame([("b", 0, 0, bytearray(sized))], "file string, stream_index int, seq long, data binary"), 4).orderBy("unit").collect()
    assert [(r.type, r.size, r.slice_type) for r in again] == [(5, len(one), 7), (1, 2, 5)]


@pytest.mark.parametrize(("profile", "fields", "crop"), [(66, 0, (0, 0, 0, 4)), (100, 1, (0, 5, 0, 2)), (77, 0, None)])
def test_sequence_sets(profile, fields, crop):
    w = BitWriter()
    w.bits(profile, 8), w.bits(0, 8), w.bits(30, 8), w.unsigned(2)
    if profile == 100:
        w.unsigned(1), w.unsigned(0), w.unsigned(0), w.bits(0, 1), w.bits(1, 1)
        for k in range(8):
            w.bits(k == 1, 1)
            if k == 1:
                for delta in (3, -11):  # the second makes the rest follow
                    w.signed(delta)
    w.unsigned(4)
    w.unsigned(profile % 3)
    if profile % 3 == 0:
        w.unsigned(6)
    elif profile % 3 == 1:
        w.bits(0, 1), w.signed(-4), w.signed(3), w.unsigned(2), w.signed(1), w.signed(-9)
    w.unsigned(4), w.bits(0, 1), w.unsigned(119), w.unsigned(67 if not fields else 33), w.bits(1 - fields, 1)
    if fields:
        w.bits(0, 1)
    w.bits(1, 1), w.bits(crop is not None, 1)
    for c in crop or ():
        w.unsigned(c)
    got = nal.sequence_set(w.body())
    x, y = (2, 2 * (1 + fields)) if crop else (0, 0)
    c = crop or (0, 0, 0, 0)
    assert got == {"profile": profile, "level": 30, "number": 2, "width": 1920 - x * (c[0] + c[1]), "height": 16 * (68 if not fields else 68) - y * (c[2] + c[3])}


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_neighbours_equal_all_pairs(spark, radius):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 9))) for b in base for _ in range(12)] + base * 3
    rows = [(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)] + [(1000, None)]
    table = spark.createDataFrame(rows, "frame_no long, hash long")
    least = {}
    for k, v in rows[:-1]:
        least.setdefault(v, k)
    want = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for x, a in least.items() for y, b in least.items() if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= radius}
    got = [tuple(r) for r in neighbours.neighbours(table, radius).select("a", "b", "distance").collect()]
    assert sorted(got) == sorted(want)
    assert {r.key: r["class"] for r in neighbours.classes(table).collect()} == {k: least[v] for k, v in rows[:-1]}
    asked = spark.createDataFrame(rows[:5], "frame_no long, hash long")
    near = {(r.asked, r.found) for r in neighbours.nearest(table, asked, radius).collect()}
    assert near == {(a, b) for a, x in rows[:5] for b, y in rows[:-1] if bin((x ^ y) & (1 << 64) - 1).count("1") <= radius}


def test_neighbours_make_no_pairs_of_copies(spark):
    table = spark.range(200_000).select(F.col("id").alias("frame_no"), F.lit(77).cast("long").alias("hash"))
    assert neighbours.neighbours(table, 3).count() == 0


def test_noise_and_dither(spark):
    made = spark.range(40).select("id", pixels.random_dither(F.array_repeat(F.lit(500), 300), F.col("id")).alias("p"), F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: pixels.noise(F.col("id"), k)).alias("n"))
    rows = made.repartition(7).orderBy("id").collect()
    assert rows == made.coalesce(1).orderBy("id").collect()
    counts = np.bincount(np.concatenate([r.n for r in rows]), minlength=16)
    assert len(counts) == 16 and counts.min() > 0.8 * 750 and counts.max() < 1.2 * 750
    assert all(r.p == [min(500 + n, 1023) * 255 // 1023 for n in r.n] for r in rows)
    assert len({tuple(r.n) for r in rows}) == 40


def test_history_over_several_blocks(spark):
    frames = spark.createDataFrame([(0, n, 1, 1, bytearray([n % 251])) for n in range(120)], FRAMES)
    for most in (3, 11, 64):
        rows = video.with_history(frames, most, lambda d, w, h, before: (sum(x[0] for x in before), len(before)), "total long, n int", block=10).collect()
        assert len(rows) == 120
        for r in rows:
            before = range(max(r.frame_no - most, 0), r.frame_no)
            assert (r.n, r.total) == (len(before), sum(n % 251 for n in before))


def test_following_over_sparse_blocks(spark):
    numbers = [0, 1, 3, 10, 11, 55, 56, 90]
    rows = pixels.following(spark.createDataFrame([(n, [n]) for n in numbers], "frame_no long, p array<int>"), block=5).collect()
    before = dict(zip(numbers[1:], numbers, strict=False))
    assert {r.frame_no: r.q for r in rows} == {n: [before[n]] if n in before else None for n in numbers}
