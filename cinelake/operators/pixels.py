"""Video operators over luma planes held as arrays (``frame_no``, ``p``), in column functions.

Planes are folded in place with higher-order functions, so that pixels are exploded only where the result is a
table of pixel counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total(p: Column | str, f: Callable[[Column], Column] = lambda x: x, kind: str = "long") -> Column:
    return F.aggregate(F.col(p) if isinstance(p, str) else p, F.lit(0).cast(kind), lambda s, x: s + f(x).cast(kind))


def clamp8(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255))


def brightness_contrast(frames: DataFrame, brightness: float, contrast: float) -> DataFrame:
    """(v - 128) * contrast + 128 + brightness, clamped, then truncated."""
    return frames.withColumn("p", F.transform("p", lambda v: F.floor(clamp8((v - 128) * F.lit(contrast) + 128 + F.lit(brightness))).cast("int")))


def at(p: str, k: Column) -> Column:
    return F.get(F.col(p), k.cast("int"))


def remap(frames: DataFrame, width: int, height: int, source: Callable[[Column, Column], Column]) -> DataFrame:
    """A new plane whose pixel (x, y) is the pixel number ``source(x, y)`` of the old one."""
    places = F.sequence(F.lit(0), F.lit(width * height - 1))
    return frames.withColumn("p", F.transform(places, lambda k: at("p", source(k % width, F.floor(k / width)))))


def crop(frames: DataFrame, width: int, x: int, y: int, w: int, h: int) -> DataFrame:
    if x < 0 or y < 0 or w < 1 or h < 1 or x + w > width:
        raise ValueError("the rectangle leaves the frame")
    return remap(frames, w, h, lambda i, j: (j + y) * width + i + x)


def rotate(frames: DataFrame, width: int, height: int, degrees: int) -> DataFrame:
    """Clockwise by a multiple of 90 degrees."""
    turn = degrees % 360
    if turn == 90:
        return remap(frames, height, width, lambda i, j: (height - 1 - i) * width + j)
    if turn == 180:
        return remap(frames, width, height, lambda i, j: (height - 1 - j) * width + width - 1 - i)
    if turn == 270:
        return remap(frames, height, width, lambda i, j: i * width + width - 1 - j)
    if turn:
        raise ValueError("only multiples of 90 degrees")
    return frames


def flip(frames: DataFrame, width: int, height: int, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    return remap(frames, width, height, lambda i, j: ((height - 1 - j) if vertical else j) * width + ((width - 1 - i) if horizontal else i))


def to_ten_bits(p: Column) -> Column:
    return F.transform(p, lambda v: F.floor(v * 1023 / 255).cast("int"))


def to_eight_bits(p: Column) -> Column:
    return F.transform(p, lambda v: F.floor(F.least(v, F.lit(1023)) * 255 / 1023).cast("int"))


def noise(frame_no: Column, place: Column) -> Column:
    """0 to 15, from the numbers of a frame and a pixel alone: the same on any partitioning, in any order."""
    x = F.pmod(F.pmod(frame_no.cast("long") * 7919 + place.cast("long") + 12345, F.lit(1 << 31)) * 2654435761, F.lit(1 << 32))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * 1103515245, F.lit(1 << 32))
    return F.shiftright(x, 20).bitwiseAND(F.lit(15))


def random_dither(p: Column, frame_no: Column) -> Column:
    """Ten bits to eight with noise of up to 15 added first."""
    return F.transform(p, lambda v, k: F.floor(F.least(v + noise(frame_no, k), F.lit(1023)) * 255 / 1023).cast("int"))


def one_dimensional_lut(p: Column, lut: list[float]) -> Column:
    """Linear interpolation in a table over 0..255."""
    table, last = F.array(*map(F.lit, lut)), len(lut) - 1

    def one(v: Column) -> Column:
        place = v * last / 255.0
        low = F.floor(place).cast("int")
        a, b = F.get(table, low), F.get(table, F.least(low + 1, F.lit(last)))
        return a + (b - a) * (place - low)

    return F.transform(p, one)


def following(frames: DataFrame, by: str = "frame_no", block: int = 4096) -> DataFrame:
    """Each frame with the plane before it as ``q`` (null for the first).

    Windows run within blocks of frame numbers; the frame before a block's first comes by an equi-join with the block
    before.  Which one that is, is told by a window over the blocks' numbers, a row each, without planes.
    """
    own = W.partitionBy("_b").orderBy(by)
    rows = frames.withColumn("_b", F.expr(f"{by} div {block}"))
    lasts = rows.groupBy("_b").agg(F.max_by("p", by).alias("_before")).withColumnRenamed("_b", "_earlier")
    order = rows.select("_b").distinct().select(F.col("_b").alias("_block"), F.lag("_b").over(W.orderBy("_b")).alias("_earlier"))
    before = order.join(lasts, "_earlier").select("_block", "_before")
    rows = rows.withColumn("_q", F.lag("p").over(own)).join(before, F.col("_b") == F.col("_block"), "left")
    return rows.withColumn("q", F.coalesce("_q", "_before")).drop("_q", "_b", "_before", "_block")


def squared_error(a: str = "p", b: str = "q") -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def absolute_difference(a: str = "p", b: str = "q") -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def mse(a: str = "p", b: str = "q") -> Column:
    return squared_error(a, b) / F.size(a)


def psnr(mse: Column) -> Column:
    """Infinite for equal planes."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / F.when(mse > 0, mse)))


def ssim_block(a: str = "p", b: str = "q") -> Column:
    """Structural similarity of two 8x8 planes, within 0 and 1."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    va = total(a, lambda x: x * x) / n - ma * ma
    vb = total(b, lambda x: x * x) / n - mb * mb
    cov = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x) / n - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def quality_rating(psnr_avg: Column, ssim_avg: Column) -> Column:
    return F.when((psnr_avg >= 45) & (ssim_avg >= 0.98), "excellent").when((psnr_avg >= 38) & (ssim_avg >= 0.95), "good").when((psnr_avg >= 32) & (ssim_avg >= 0.9), "fair").when((psnr_avg >= 25) & (ssim_avg >= 0.8), "poor").otherwise("bad")


def histogram(frames: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Counts of each value, over all frames or by key."""
    keys = key or []
    return frames.select(*keys, F.explode("p").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def histogram_peak(frames: DataFrame) -> DataFrame:
    """The most frequent value of each frame; the highest of equals."""
    counts = histogram(frames, ["frame_no"])
    return counts.groupBy("frame_no").agg(F.max_by("bin", F.struct("n", "bin")).alias("peak"), F.max("n").alias("n"))


def waveform(frames: DataFrame, width: int) -> DataFrame:
    """Counts of values in each column of pixels."""
    pixels = frames.select(F.posexplode("p").alias("k", "luma"))
    return pixels.groupBy((F.col("k") % width).alias("column"), "luma").agg(F.count("*").alias("n"))


def vectorscope(pairs: DataFrame) -> DataFrame:
    """Counts of (u, v) of planes ``u`` and ``v``."""
    pixels = pairs.select(F.explode(F.arrays_zip("u", "v")).alias("_z")).select("_z.u", "_z.v")
    return pixels.groupBy("u", "v").agg(F.count("*").alias("n"))


def broadcast_safe(scope: DataFrame) -> DataFrame:
    """Percent of pixels within 118 of the neutral point; 100 without pixels."""
    safe = (F.col("u") - 128) * (F.col("u") - 128) + (F.col("v") - 128) * (F.col("v") - 128) <= 118 * 118
    return scope.agg((F.coalesce(F.sum(F.when(safe, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(1.0)) * 100).alias("percent"))


def dark_share(p: str, threshold: int) -> Column:
    return total(p, lambda v: F.when(v < threshold, 1).otherwise(0)) / F.size(p)


def is_black(p: str, threshold: int, coverage: float) -> Column:
    return dark_share(p, threshold) >= coverage


def average_luma(p: str) -> Column:
    return total(p) / F.size(p) / 255


def spatial_complexity(p: str) -> Column:
    n = F.size(p)
    variance = (total(p, lambda x: x * x) * n - total(p) * total(p)) / (n * n).cast("double")
    return F.least(variance / 65025, F.lit(1.0))


def temporal_complexity(p: str = "p", q: str = "q") -> Column:
    return F.least(absolute_difference(p, q) / (F.size(p) * 255), F.lit(1.0))


def chi_square(frames: DataFrame, bins: int) -> DataFrame:
    """``frame_no, distance``: half the chi-square distance of the histograms of ``p`` and ``q``; null without ``q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, q in zip(b.column(1), b.column(2), strict=True):
                if not q.is_valid:
                    out.append(None)
                    continue
                x, y = (np.bincount(v.values.to_numpy() * bins // 256, minlength=bins).astype(np.float64) for v in (p, q))
                some = x + y > 0
                out.append(float(((x - y)[some] ** 2 / (x + y)[some]).sum() / 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["frame_no", "distance"])

    return frames.select(F.col("frame_no").cast("long").alias("frame_no"), "p", "q").mapInArrow(run, "frame_no long, distance double")


def average_hash(p: str) -> Column:
    """A bit for each of 64 pixels above the integer mean, the first pixel highest.  The mean is made once, not for each pixel."""
    mean = F.floor(total(p) / F.size(p))
    return F.get(F.transform(F.array(mean), lambda m: bits(F.transform(F.col(p), lambda v: v > m))), F.lit(0))


def difference_hash(p: str, width: int = 8) -> Column:
    """A bit for each pixel less than its right neighbour; the last of a row is compared with the first."""
    places = F.sequence(F.lit(0), F.lit(63))
    right = lambda k: F.when(k % width == width - 1, k - width + 1).otherwise(k + 1)
    return bits(F.transform(places, lambda k: at(p, k) < at(p, right(k))))


def median_hash(p: str) -> Column:
    """A bit for each pixel above the upper median."""
    median = F.get(F.array_sort(F.col(p)), F.lit(32))
    return bits(F.transform(F.col(p), lambda v: v > median))


def bits(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(F.when(b, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column, hashes: int = 1) -> Column:
    return 1 - distance / (64.0 * hashes)


def effective_bit_depth(p: str) -> Column:
    return F.log2(F.size(F.array_distinct(F.transform(F.col(p), lambda v: F.least(v, F.lit(1023)))))) / F.log2(F.lit(1024.0)) * 10


def banding_percent(p: str, step: int) -> Column:
    """Percent of neighbours that differ by one to ``step``."""
    pairs = F.zip_with(F.slice(F.col(p), 1, F.size(p) - 1), F.slice(F.col(p), 2, F.size(p) - 1), lambda a, b: F.when(F.abs(a - b).between(1, step), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) * 100.0 / (F.size(p) - 1)


def blend(a: str, b: str, t: float) -> Column:
    """Frame interpolation by mixing, truncated."""
    return F.zip_with(F.col(a), F.col(b), lambda x, y: F.floor(x * F.lit(1 - t) + y * F.lit(t)).cast("int"))


def moving_average_denoise(frames: DataFrame, n: int) -> DataFrame:
    """Mean, truncated, of each pixel over the last ``n`` frames (of consecutive numbers); the first frame passes.

    Each frame goes to the ``n`` frames that it takes part in, so that at most ``n`` planes meet.
    """
    sent = frames.select(F.explode(F.sequence(F.col("frame_no"), F.col("frame_no") + n - 1)).alias("_to"), "p")
    met = sent.groupBy("_to").agg(F.collect_list("p").alias("_ps"))
    added = F.aggregate(F.slice("_ps", 2, n), F.get("_ps", F.lit(0)), lambda s, p: F.zip_with(s, p, lambda x, y: x + y))
    means = met.select("_to", F.transform(added, lambda v: F.floor(v / F.size("_ps")).cast("int")).alias("p"))
    return frames.select("frame_no").join(means, F.col("frame_no") == F.col("_to")).select("frame_no", "p")


def split_fields(frames: DataFrame, width: int) -> DataFrame:
    """Even and odd rows of pixels."""
    rows = lambda parity: F.filter(F.col("p"), lambda v, k: F.floor(k / width) % 2 == parity)
    return frames.select("frame_no", rows(0).alias("top"), rows(1).alias("bottom"))


def key_mask(a: str, b: str, c: str, target: tuple[int, int, int], tolerance: int) -> Column:
    """0 where the sum of channel differences, modulo 256, is within the tolerance, else 255."""
    z = F.arrays_zip(a, b, c)
    d = lambda x: F.pmod(F.abs(x[a] - target[0]) + F.abs(x[b] - target[1]) + F.abs(x[c] - target[2]), F.lit(256))
    return F.transform(z, lambda x: F.when(d(x) <= tolerance, 0).otherwise(255))


def box_blur(p: str, width: int, height: int) -> Column:
    """3x3 integer mean of the inner pixels; border pixels stay."""
    def one(k: Column) -> Column:
        x, y = k % width, F.floor(k / width)
        around = [at(p, k + dy * width + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
        return F.when(inner, F.floor(sum(around[1:], around[0]) / 9)).otherwise(at(p, k)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), one)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def rgb_to_yuv(r: Column, g: Column, b: Column, kr: float = 0.299, kb: float = 0.114) -> Column:
    """Full range, clamped then truncated (after nine digits, so that sums in another order give the same)."""
    y = kr * r + (1 - kr - kb) * g + kb * b
    u, v = (b - y) / (2 * (1 - kb)) + 128, (r - y) / (2 * (1 - kr)) + 128
    return F.struct(*[F.floor(F.round(clamp8(x), 9)).cast("int").alias(n) for n, x in (("y", y), ("u", u), ("v", v))])


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value within one."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = (most - least).cast("double")
    safe = F.when(d > 0, d)
    h = F.when(d == 0, 0.0).when(most == r, 60 * ((g - b) / safe)).when(most == g, 60 * ((b - r) / safe + 2)).otherwise(60 * ((r - g) / safe + 4))
    h = F.when(h < 0, h + 360).otherwise(h)
    return F.struct(h.alias("h"), F.when(most == 0, 0.0).otherwise(d / F.when(most > 0, most)).alias("s"), (most / 255.0).alias("v"))


def premultiply(c: Column, a: Column) -> Column:
    return F.floor(c * a / 255).cast("int")


def composite_over(c1: Column, a1: Column, c2: Column, a2: Column) -> tuple[Column, Column]:
    """Premultiplied source over background: colour and alpha."""
    mix = lambda s, b: F.least(s + F.floor(b * (255 - a1) / 255), F.lit(255)).cast("int")
    return mix(c1, c2), mix(a1, a2)


def quality_score(brightness: Column, contrast: Column, sharpness: Column, color: Column, blur: Column) -> Column:
    """Weighted parts of a frame's quality, within one."""
    score = 0.15 * brightness + 0.25 * contrast + 0.3 * sharpness + 0.15 * color + 0.15 * (1 - blur)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def sharpness(p: str, width: int) -> Column:
    """Mean difference of right-hand neighbours in a row, over 255."""
    pairs = F.zip_with(F.slice(F.col(p), 1, F.size(p) - 1), F.slice(F.col(p), 2, F.size(p) - 1), lambda a, b: F.abs(a - b))
    inner = F.filter(pairs, lambda d, k: k % width != width - 1)
    return F.aggregate(inner, F.lit(0).cast("long"), lambda s, x: s + x) / (F.size(inner) * 255)


def rolling_shutter_shift(motion: Column, row: Column, height: int, readout: float) -> Column:
    """Share of a frame's motion that a row has seen."""
    return motion * row / height * readout


def parade(frames: DataFrame, sections: int = 3) -> DataFrame:
    """``section, bin, n``: a histogram of each part of the planes, which are cut in sections of equal length."""
    rows = frames.select(F.size("p").alias("_n"), F.posexplode("p").alias("k", "bin"))
    return rows.groupBy(F.expr(f"cast(k * {sections} div _n as int)").alias("section"), "bin").agg(F.count("*").alias("n"))


def low_bits_share(p: str) -> Column:
    """Share of ten-bit pixels whose lowest two bits are in use."""
    return total(p, lambda v: F.when(v % 4 != 0, 1).otherwise(0)) / F.size(p)


def true_ten_bit(p: str, least: float = 0.1) -> Column:
    """Whether a plane uses its ten bits, and is not eight bits scaled up."""
    return low_bits_share(p) > least
