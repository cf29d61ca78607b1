"""Plane kernels that neighbourhoods of pixels make too wide for column functions, in Arrow batches.

Each works on whole planes (``width``, ``height``, ``p`` as an array of integers) and keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_planes(frames: DataFrame, width: int, height: int, f: Callable[[np.ndarray], np.ndarray], column: str = "p") -> DataFrame:
    """Apply ``f`` to stacks of planes (frames x height x width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            stack = np.asarray(b.column(i).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, height, width)
            out = f(stack.astype(np.float64)).reshape(b.num_rows, -1).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([made if k == i else b.column(k) for k in range(b.num_columns)], b.schema.names)

    return frames.mapInArrow(run, frames.schema)


def lanczos_weights(size: int, to: int, lobes: int = 3) -> np.ndarray:
    """A ``to`` x ``size`` matrix of normalised Lanczos weights; wider when shrinking."""
    scale = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to - 0.5
    x = (np.arange(size)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.round(x, 9), 0, 255))


def scale(frames: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    across, down = lanczos_weights(width, to_width), lanczos_weights(height, to_height)
    return map_planes(frames, width, height, lambda s: to_bytes(np.einsum("yh,nhw,xw->nyx", down, s, across)))


def gaussian_weights(sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def blurred(stack: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with repeated edges."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    for axis in (1, 2):
        wide = np.pad(stack, [(0, 0), (r, r) if axis == 1 else (0, 0), (r, r) if axis == 2 else (0, 0)], mode="edge")
        n = stack.shape[axis]
        stack = sum(w[k] * np.take(wide, np.arange(k, k + n), axis=axis) for k in range(len(w)))
    return stack


def gaussian_denoise(frames: DataFrame, width: int, height: int, sigma: float) -> DataFrame:
    return map_planes(frames, width, height, lambda s: to_bytes(blurred(s, sigma)))


def unsharp(frames: DataFrame, width: int, height: int, sigma: float, amount: float, threshold: float = 0.0) -> DataFrame:
    """Adds the difference to the blurred plane where it exceeds the threshold."""

    def run(s: np.ndarray) -> np.ndarray:
        d = s - blurred(s, sigma)
        return to_bytes(np.where(np.abs(d) > threshold, s + amount * d, s))

    return map_planes(frames, width, height, run)


def bilateral(frames: DataFrame, width: int, height: int, radius: int, space: float, tone: float) -> DataFrame:
    """Mean of the neighbourhood, weighted by distance and by difference of value."""

    def run(s: np.ndarray) -> np.ndarray:
        wide = np.pad(s, [(0, 0), (radius, radius), (radius, radius)], mode="edge")
        total, weight = np.zeros_like(s), np.zeros_like(s)
        for dy in range(2 * radius + 1):
            for dx in range(2 * radius + 1):
                v = wide[:, dy : dy + height, dx : dx + width]
                near = ((dy - radius) ** 2 + (dx - radius) ** 2) / (2 * space**2)
                w = np.exp(-near - (v - s) ** 2 / (2 * tone**2))
                total += w * v
                weight += w
        return to_bytes(total / weight)

    return map_planes(frames, width, height, run)


def floyd_steinberg(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Ten bits to eight with error diffusion in integers, all planes of a batch in step.

    Values are truncated to eight bits; what is lost, in ten bits, goes on in sixteenths, each part truncated.
    """

    def run(s: np.ndarray) -> np.ndarray:
        s = s.astype(np.int64)
        out = np.zeros_like(s)
        for y in range(height):
            for x in range(width):
                out[:, y, x] = np.clip(s[:, y, x], 0, 1023) * 255 // 1023
                lost = s[:, y, x] - out[:, y, x] * 1023 // 255
                for dx, dy, w in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if 0 <= x + dx < width and y + dy < height:
                        s[:, y + dy, x + dx] += np.sign(lost) * (np.abs(lost) * w // 16)
        return out

    return map_planes(frames, width, height, run)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi / n * (k[None, :] + 0.5) * k[:, None]) * np.sqrt(np.where(k == 0, 1, 2) / n)[:, None]


def bilinear_weights(size: int, to: int) -> np.ndarray:
    place = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
    low = np.minimum(np.floor(place).astype(int), size - 2) if size > 1 else np.zeros(to, int)
    w = np.zeros((to, size))
    w[np.arange(to), low] = 1 - (place - low)
    w[np.arange(to), np.minimum(low + 1, size - 1)] += place - low
    return w


def perceptual_hash(frames: DataFrame, width: int, height: int) -> DataFrame:
    """``frame_no, hash``: bits of the low 8x8 block of the cosine transform of 32x32 above its upper median."""
    across, down, d = bilinear_weights(width, 32), bilinear_weights(height, 32), dct_matrix(32)[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            stack = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, height, width)
            low = np.round(np.einsum("ky,nyx,lx->nkl", d, np.einsum("yh,nhw,xw->nyx", down, stack, across), d), 6).reshape(b.num_rows, 64)
            bits = low > np.sort(low, axis=1)[:, 32:33]
            hashes = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes)], ["frame_no", "hash"])

    return frames.select("frame_no", "p").mapInArrow(run, "frame_no long, hash long")


def window_means(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """Means of all size x size blocks, ``step`` apart, of one plane."""
    total = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y = np.arange(0, x.shape[0] - size + 1, step)
    z = np.arange(0, x.shape[1] - size + 1, step)
    s = total[np.ix_(y + size, z + size)] - total[np.ix_(y, z + size)] - total[np.ix_(y + size, z)] + total[np.ix_(y, z)]
    return s / size**2


def ssim(a: np.ndarray, b: np.ndarray, size: int = 8, step: int = 4) -> float:
    """Mean structural similarity of 8x8 blocks four apart, each within 0 and 1; smaller planes are an error."""
    if min(a.shape) < size:
        raise ValueError("planes are smaller than a block")
    ma, mb = window_means(a, size, step), window_means(b, size, step)
    va, vb, ab = (window_means(x, size, step) for x in (a * a, b * b, a * b))
    va, vb, ab = va - ma * ma, vb - mb * mb, ab - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(np.clip((2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), 0, 1).mean())


#: Weights of the scales of multi-scale similarity.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def multi_scale_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted product over up to five scales, each halved by the integer mean of 2x2 pixels; stops below 8x8."""
    out = 1.0
    for w in SCALES:
        out *= ssim(a, b) ** w
        h, v = a.shape[0] // 2, a.shape[1] // 2
        if min(h, v) < 8:
            break
        a, b = (np.floor(x[: 2 * h, : 2 * v].reshape(h, 2, v, 2).mean((1, 3))) for x in (a, b))
    return out


def compare_planes(pairs: DataFrame, width: int, height: int, measure: Callable[[np.ndarray, np.ndarray], float] = ssim) -> DataFrame:
    """``frame_no, score`` of reference ``p`` and distorted ``q``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            planes = [np.asarray(b.column(k).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, height, width) for k in (1, 2)]
            scores = [measure(x, y) for x, y in zip(*planes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["frame_no", "score"])

    return pairs.select("frame_no", "p", "q").mapInArrow(run, "frame_no long, score double")
