"""Frames between frames by motion compensation, and frame rates made with them.

Each block of a frame is held against the next frame at every shift of a search window; all blocks of a frame are compared at
once for a shift, by the difference of two planes and its sums over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold
from .video import TYPES, framed


def shifted(plane: np.ndarray, dx: np.ndarray | int, dy: np.ndarray | int) -> np.ndarray:
    """The pixels that stand ``dx`` to the right and ``dy`` below each place; beyond an edge its own."""
    h, w = plane.shape
    rows, columns = np.arange(h)[:, None] + dy, np.arange(w)[None, :] + dx
    return plane[np.clip(rows, 0, h - 1), np.clip(columns, 0, w - 1)]


def motion_of(a: np.ndarray, b: np.ndarray, block: int = 16, reach: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The shift (x, y) of each block of ``a`` to where ``b`` differs least from it.

    Of equally good shifts the uppermost counts, then the leftmost.
    """
    h, w = a.shape
    starts = np.arange(0, h, block), np.arange(0, w, block)
    best = np.full((len(starts[0]), len(starts[1])), np.iinfo(np.int64).max)
    dx, dy = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
    wide = a.astype(np.int64)
    for y in range(-reach, reach + 1):
        moved = shifted(b, 0, y).astype(np.int64)
        for x in range(-reach, reach + 1):
            cost = np.add.reduceat(np.add.reduceat(np.abs(wide - shifted(moved, x, 0)), starts[0], axis=0), starts[1], axis=1)
            less = cost < best
            best, dx, dy = np.where(less, cost, best), np.where(less, x, dx), np.where(less, y, dy)
    return dx, dy


def between(a: np.ndarray, b: np.ndarray, t: float, motion: tuple[np.ndarray, np.ndarray], block: int = 16) -> np.ndarray:
    """The plane at ``t`` between two: each pixel of the first with that of the second at its block's shift so far, mixed and truncated."""
    spread = lambda v: np.trunc(v * t).astype(np.int64).repeat(block, 0).repeat(block, 1)[: a.shape[0], : a.shape[1]]
    met = shifted(b, spread(motion[0]), spread(motion[1]))
    return np.floor((1.0 - t) * a + t * met).astype(np.uint8)


def interpolated(a: bytes, b: bytes, width: int, height: int, times: list[float], block: int = 16, reach: int = 16) -> list[bytes]:
    """YUV420P frames at several times between two; the motion is that of luma, and chroma is mixed in place."""
    size = width * height
    luma = [np.frombuffer(d, np.uint8, size).reshape(height, width) for d in (a, b)]
    rest = [np.frombuffer(d, np.uint8)[size:].astype(np.float64) for d in (a, b)]
    motion = motion_of(*luma, block, reach) if any(0 < t for t in times) else None
    out = []
    for t in times:
        if not t:
            out.append(a)
        else:
            out.append(between(*luma, t, motion, block).tobytes() + np.floor((1.0 - t) * rest[0] + t * rest[1]).astype(np.uint8).tobytes())
    return out


class _Between:
    """Pairs of neighbours in a block of a stream; of those of other blocks only the frame before the first one counts."""

    def __init__(self, key: tuple, factor: float, size: int, block: int, reach: int):
        self.stream, self.own, self.factor, self.size, self.block, self.reach = key[0], key[1], factor, size, block, reach
        self.before: tuple | None = None

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in rows.to_pylist():
            n, last = r["frame_no"], r["_last"]
            if self.before is not None and n // self.size == self.own:
                out += self._made(self.before, r)
            if n == last and n // self.size == self.own:
                out += self._made(r, r)
            self.before = r
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], TYPES[t]) for k, t in enumerate(("long", "long", "int", "int", "binary"))], ["stream", "frame_no", "width", "height", "data"])

    def _made(self, a: dict, b: dict) -> Iterator[tuple]:
        low, count = a["frame_no"], round((a["_last"] + 1) / self.factor)
        first = max(int(low / self.factor) - 1, 0)
        places = [k for k in range(first, min(int((low + 1) / self.factor) + 2, count)) if int(k * self.factor) == low]
        times = [k * self.factor - low for k in places] if a is not b else [0.0] * len(places)
        frames = interpolated(a["data"], b["data"], a["width"], a["height"], times, self.block, self.reach) if places else []
        return zip([self.stream] * len(places), places, [a["width"]] * len(places), [a["height"]] * len(places), frames, strict=True)

    def finish(self) -> None:
        return None


def slow_motion(frames: DataFrame, factor: float, block: int = 16, reach: int = 16, stretch: int = 256) -> DataFrame:
    """YUV420P frames (numbers from 0 on) played at ``factor`` (above 0, at most 1) of the speed, those between made by motion.

    Streams are cut in stretches; a stretch's last frame also opens the next one.  Behind the last frame of a stream it stands still.
    """
    if not 0 < factor <= 1:
        raise ValueError("the factor is above 0 and at most 1")
    rows = framed(frames)
    last = rows.groupBy("stream").agg(F.max("frame_no").alias("_last")).withColumnRenamed("stream", "_s")
    own = F.expr(f"frame_no div {stretch}")
    rows = rows.withColumn("_b", F.explode(F.sequence(own, F.expr(f"(frame_no + 1) div {stretch}")))).join(last, F.col("stream") == F.col("_s")).drop("_s")
    return ordered_fold(rows, ["stream", "_b"], ["frame_no"], lambda key: _Between(key, factor, stretch, block, reach), "stream long, frame_no long, width int, height int, data binary")
