"""Transform coding of 8 x 8 blocks: an integer cosine transform in butterflies, quantisation, and their inverses.

Whole stacks of blocks are transformed at once; a frame's plane is a stack of its blocks in raster order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .video import framed

#: Multipliers with the bits that they are shifted back by.
WEIGHT_SIX, BITS_SIX = 35468, 15
WEIGHT_FOUR, WEIGHT_ODD, BITS_FOUR = 46341, 39200, 16


def butterflies(x: np.ndarray) -> np.ndarray:
    """The transform along the last axis, of eight numbers each; products are shifted back one by one, downwards."""
    mirrored = x[..., ::-1]
    plus, minus = (x + mirrored)[..., :4], (x - mirrored)[..., :4]
    outer, inner = plus[..., 0] + plus[..., 3], plus[..., 1] + plus[..., 2]
    tilt, bend = plus[..., 0] - plus[..., 3], (plus[..., 1] - plus[..., 2]) * WEIGHT_SIX >> BITS_SIX
    four = lambda v: v * WEIGHT_FOUR >> BITS_FOUR
    odd = lambda v: v * WEIGHT_ODD >> BITS_FOUR
    first, second, third, last = (minus[..., k] for k in range(4))
    a, b = four(last) + odd(third), odd(last) - four(third)
    return np.stack([outer + inner, first + a, tilt + bend, first - a, outer - inner, second + b, tilt - bend, second - b], axis=-1)


def transform(blocks: np.ndarray) -> np.ndarray:
    """Rows, then columns of stacked blocks (.., 8, 8), divided by eight and rounded; the inverse is the same."""
    rows = butterflies(blocks.astype(np.int64))
    both = butterflies(rows.swapaxes(-1, -2)).swapaxes(-1, -2)
    return both + 4 >> 3


def forward(pixels: np.ndarray, bits: int = 8) -> np.ndarray:
    """Coefficients of pixels of 8 or 10 bits, around their middle."""
    return transform(pixels.astype(np.int64) - (1 << bits - 1))


def divisors(matrix: np.ndarray, scale: int) -> np.ndarray:
    """What scaled coefficients are divided by: the weights, and for the mean the scale itself."""
    out = np.maximum(matrix.astype(np.int64), 1) * 16
    out[..., 0, 0] = scale * 16
    return out


def quantised(coefficients: np.ndarray, matrix: np.ndarray, scale: int) -> np.ndarray:
    """Coefficients times the scale over the weights, rounded half away from zero."""
    by, scaled = divisors(matrix, scale), coefficients.astype(np.int64) * scale
    size = (np.abs(scaled) + by // 2) // np.where(by == 0, 1, by)
    return np.where(by == 0, coefficients, np.sign(scaled) * size)


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """The blocks of a plane in raster order; its edges are repeated to whole blocks."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


BLOCKS = "stream long, frame_no long, block int, coefficients array<int>"


def luma_blocks(frames: DataFrame, matrix: np.ndarray | None = None, scale: int = 1) -> DataFrame:
    """A row per block of the luma plane of each YUV420P frame with its coefficients in raster order, quantised by a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                plane = np.frombuffer(r["data"], np.uint8)[: r["width"] * r["height"]].reshape(r["height"], r["width"])
                made = forward(blocks_of(plane))
                made = made if matrix is None else quantised(made, matrix, scale)
                n = len(made)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(made.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([r["stream"]] * n, pa.int64()), pa.array([r["frame_no"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), lists], ["stream", "frame_no", "block", "coefficients"])

    return framed(frames).mapInArrow(run, BLOCKS)
