"""Operators over whole frames held as bytes (``stream, frame_no, width, height, data``), in numpy over Arrow batches.

``data`` is interleaved RGB, or the planes Y, U and V of YUV420P one after the other.  Frame numbers count up by one in
each stream.  What needs the frames before runs over blocks of a stream: a block's last frames are repeated at the head
of the next block, so that a long stream is spread over many tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .folds import ordered_fold
from .islands import islands

FRAME = "stream long, frame_no long, width int, height int, data binary"
TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
Planes = tuple[np.ndarray, np.ndarray, np.ndarray]


def _rows(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def map_frames(frames: DataFrame, f: Callable[[bytes, int, int], tuple]) -> DataFrame:
    """Frames whose width, height and data are ``f`` of the old ones' data, width and height."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [f(d, w, h) for d, w, h in _rows(b, "data", "width", "height")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary())], [c.split()[0] for c in FRAME.split(", ")])

    return framed(frames).mapInArrow(run, FRAME)


def framed(frames: DataFrame) -> DataFrame:
    """The columns of a frame, in their types."""
    return frames.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FRAME.split(", ")])


def measure_frames(frames: DataFrame, f: Callable[[bytes, int, int], tuple], schema: str) -> DataFrame:
    """``stream, frame_no`` and the values of ``f`` for each frame."""
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [f(d, w, h) for d, w, h in _rows(b, "data", "width", "height")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([m[k] for m in made], TYPES[t]) for k, (_, t) in enumerate(fields)]], ["stream", "frame_no", *[n for n, _ in fields]])

    return framed(frames).mapInArrow(run, f"stream long, frame_no long, {schema}")


class _History:
    """The frames before, up to ``most``; frames of an earlier block only go into it."""

    def __init__(self, key: tuple, most: int, block: int, f: Callable, schema: str):
        self.stream, self.block, self.size, self.f = key[0], key[1], block, f
        self.fields = [c.split() for c in schema.split(", ")]
        self.before: deque = deque(maxlen=most)

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, w, h, data in _rows(rows, "frame_no", "width", "height", "data"):
            if n // self.size == self.block:
                out.append((self.stream, n, *self.f(data, w, h, list(self.before))))
            self.before.append(data)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], TYPES[t]) for k, (_, t) in enumerate(self.fields)], [n for n, _ in self.fields])

    def finish(self) -> None:
        return None


def with_history(frames: DataFrame, most: int, f: Callable[[bytes, int, int, list[bytes]], tuple], schema: str, block: int = 512) -> DataFrame:
    """``stream, frame_no`` and the values of ``f`` for each frame and the data of up to ``most`` frames before it."""
    schema = f"stream long, frame_no long, {schema}"
    ahead = F.sequence(F.expr(f"frame_no div {block}"), F.expr(f"(frame_no + {most}) div {block}"))  # all blocks that look back on it
    rows = framed(frames).withColumn("_b", F.explode(ahead))
    return ordered_fold(rows, ["stream", "_b"], ["frame_no"], lambda key: _History(key, most, block, f, schema), schema)


# YUV420P


def planes_of(data: bytes, width: int, height: int) -> Planes:
    """Y, U and V; too little data is an error."""
    w, h = width // 2, height // 2
    if len(data) < width * height + 2 * w * h:
        raise ValueError("too little data for the planes")
    raw = np.frombuffer(data, np.uint8)
    y, c = width * height, w * h
    return raw[:y].reshape(height, width), raw[y : y + c].reshape(h, w), raw[y + c : y + 2 * c].reshape(h, w)


def joined(planes: Planes) -> bytes:
    return b"".join(np.ascontiguousarray(p, dtype=np.uint8).tobytes() for p in planes)


def map_planes(frames: DataFrame, f: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``f`` of each plane (and what its sides are divided by: 1 for luma, 2 for chroma)."""

    def run(data: bytes, width: int, height: int) -> tuple:
        made = tuple(f(p, k) for p, k in zip(planes_of(data, width, height), (1, 2, 2), strict=True))
        return made[0].shape[1], made[0].shape[0], joined(made)

    return map_frames(frames, run)


def scale(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Lanczos of three lobes, plane by plane."""

    def one(p: np.ndarray, k: int) -> np.ndarray:
        down, across = kernels.lanczos_weights(p.shape[0], height // k), kernels.lanczos_weights(p.shape[1], width // k)
        return kernels.to_bytes(down @ p @ across.T)

    return map_planes(frames, one)


def crop(frames: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A rectangle within the frame (outside is an error); its sides and place are halved for chroma."""

    def one(p: np.ndarray, k: int) -> np.ndarray:
        if min(x, y) < 0 or min(width, height) < 1 or (x + width) // k > p.shape[1] or (y + height) // k > p.shape[0]:
            raise ValueError("the rectangle leaves the frame")
        return p[y // k : y // k + height // k, x // k : x // k + width // k]

    return map_planes(frames, one)


def rotate(frames: DataFrame, degrees: int) -> DataFrame:
    if degrees % 90:
        raise ValueError("only multiples of 90 degrees")
    return map_planes(frames, lambda p, k: np.rot90(p, -(degrees % 360) // 90))


def flip(frames: DataFrame, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    return map_planes(frames, lambda p, k: p[:: -1 if vertical else 1, :: -1 if horizontal else 1])


def compare(reference: DataFrame, distorted: DataFrame) -> DataFrame:
    """``stream, frame_no``, error, signal-to-noise ratio and similarity of each plane, and their 6:1:1 means.

    Frames are joined by number; sizes that differ are an error.  Equal planes have an infinite ratio.  ``ms_ssim`` is
    of luma.
    """
    names = [f"{m}_{p}" for m in ("mse", "psnr", "ssim") for p in "yuv"] + ["psnr_avg", "ssim_avg", "ms_ssim"]
    both = framed(reference).join(framed(distorted).select("stream", "frame_no", F.col("data").alias("_other")), ["stream", "frame_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, one, two in _rows(b, "width", "height", "data", "_other"):
                if len(one) != len(two):
                    raise ValueError("frames of unequal size")
                pairs = [(x.astype(np.float64), y.astype(np.float64)) for x, y in zip(planes_of(one, w, h), planes_of(two, w, h), strict=True)]
                error = [float(((x - y) ** 2).mean()) for x, y in pairs]
                ratio = [10 * float(np.log10(65025.0 / e)) if e else float("inf") for e in error]
                alike = [kernels.ssim(x, y) for x, y in pairs]
                mean = lambda v: (6 * v[0] + v[1] + v[2]) / 8
                out.append((*error, *ratio, *alike, mean(ratio), mean(alike), kernels.multi_scale_ssim(*pairs[0])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[k] for r in out], pa.float64()) for k in range(len(names))]], ["stream", "frame_no", *names])

    return both.mapInArrow(run, "stream long, frame_no long, " + ", ".join(f"{n} double" for n in names))


#: Weights of red and blue in luma.
LUMA = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


def rgb_to_yuv420p(frames: DataFrame, matrix: str = "bt709", full: bool = True) -> DataFrame:
    """Full or limited range; chroma is that of the upper left pixel of each block of four."""
    kr, kb = LUMA[matrix]

    def run(data: bytes, w: int, h: int) -> tuple:
        r, g, b = np.moveaxis(rgb_of(data, w, h).astype(np.float64), 2, 0)
        y = kr * r + (1 - kr - kb) * g + kb * b
        u, v = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))
        if full:
            y, u, v = y, u + 128, v + 128
        else:
            y = np.clip(16 + y * 219 / 255, 16, 235)
            u, v = (np.clip(128 + c * 224 / 255, 16, 240) for c in (u, v))
        even = lambda p: p[: h // 2 * 2 : 2, : w // 2 * 2 : 2]
        return w, h, joined(tuple(kernels.to_bytes(p) for p in (y, even(u), even(v))))

    return map_frames(frames, run)


def yuv420p_to_rgb(frames: DataFrame, matrix: str = "bt709", full: bool = True) -> DataFrame:
    """Full or limited range; each chroma value stands for its block of four pixels."""
    kr, kb = LUMA[matrix]

    def run(data: bytes, w: int, h: int) -> tuple:
        y, u, v = (p.astype(np.float64) for p in planes_of(data, w, h))
        u, v = (np.repeat(np.repeat(p, 2, 0), 2, 1) - 128 for p in (u, v))
        if not full:
            y = np.clip((y - 16) * 255 / 219, 0, 255)
            u, v = (np.clip(c * 255 / 224, -128, 127) for c in (u, v))
        r, b = y + 2 * (1 - kr) * v, y + 2 * (1 - kb) * u
        g = (y - kr * r - kb * b) / (1 - kr - kb)
        return w, h, kernels.to_bytes(np.stack([r, g, b], 2)).astype(np.uint8).tobytes()

    return map_frames(frames, run)


# RGB


def rgb_of(data: bytes, width: int, height: int) -> np.ndarray:
    if len(data) != 3 * width * height:
        raise ValueError("the data do not fit the frame")
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def luma_of(x: np.ndarray) -> np.ndarray:
    """Luma in single precision."""
    x = x.astype(np.float32)
    return np.float32(0.2126) * x[..., 0] + np.float32(0.7152) * x[..., 1] + np.float32(0.0722) * x[..., 2]


def histograms(frames: DataFrame) -> DataFrame:
    """``stream, frame_no, channel, bin, n``: counts of red, green, blue and (truncated) luma values that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stream, n, w, h, data in _rows(b, "stream", "frame_no", "width", "height", "data"):
                x = rgb_of(data, w, h)
                for name, values in (("r", x[..., 0]), ("g", x[..., 1]), ("b", x[..., 2]), ("luma", luma_of(x).astype(np.uint8))):
                    counts = np.bincount(values.ravel(), minlength=256)
                    out += [(stream, n, name, int(k), int(counts[k])) for k in np.flatnonzero(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["stream", "frame_no", "channel", "bin", "n"])

    return framed(frames).mapInArrow(run, "stream long, frame_no long, channel string, bin int, n long")


def clipping(counts: DataFrame) -> DataFrame:
    """``stream, frame_no, r, g, b``: whether more than a hundredth (truncated) of the pixels are at an end of the range."""
    end = lambda c, k: F.sum(F.when((F.col("channel") == c) & (F.col("bin") == k), F.col("n")).otherwise(0))
    limit = F.floor(F.sum(F.when(F.col("channel") == "r", F.col("n")).otherwise(0)) * 0.01)
    return counts.groupBy("stream", "frame_no").agg(*[((end(c, 0) > limit) | (end(c, 255) > limit)).alias(c) for c in "rgb"])


def dark(frames: DataFrame, threshold: float = 0.1, coverage: float = 0.98) -> DataFrame:
    """``stream, frame_no, level, black, luma``: share of dark pixels, whether they cover enough, mean luma within one."""

    def one(data: bytes, w: int, h: int) -> tuple:
        y = luma_of(rgb_of(data, w, h))
        level = float((y.astype(np.uint8) < int(threshold * 255)).mean())
        return level, level >= coverage, float(y.astype(np.float64).mean() / 255)

    return measure_frames(frames, one, "level double, black boolean, luma double")


def laplacian(x: np.ndarray) -> np.ndarray:
    """Nine times a pixel less the sum of its block of nine, of the inner pixels."""
    h, w = x.shape[:2]
    around = sum(x[dy : h - 2 + dy, dx : w - 2 + dx] for dy in range(3) for dx in range(3))
    return 9 * x[1:-1, 1:-1] - around


def adaptive_sharpen(frames: DataFrame, amount: float, edge: float = 30.0) -> DataFrame:
    """Adds a pixel's edge to it, the less the weaker it is below the threshold; border pixels stay."""

    def run(data: bytes, w: int, h: int) -> tuple:
        x = rgb_of(data, w, h).astype(np.float64)
        d = laplacian(x)
        strength = np.abs(d) / 8
        made = x[1:-1, 1:-1] + np.where(strength > edge, amount, amount * strength / edge) * d
        x[1:-1, 1:-1] = np.clip(np.floor(made + 0.5), 0, 255)
        return w, h, x.astype(np.uint8).tobytes()

    return map_frames(frames, run)


def quality_of(x: np.ndarray) -> tuple[float, float, float, float]:
    """Brightness, contrast, sharpness and colour diversity of a frame, within one."""
    y = x[..., 0] * 0.299 + x[..., 1] * 0.587 + x[..., 2] * 0.114
    edges = laplacian(x[..., 1]) if min(x.shape[:2]) > 2 else np.zeros(1)
    spread = float(x.reshape(-1, 3).std(0).mean())
    # fixed values: what counts as full contrast, diversity and sharpness
    return float(np.floor(np.round(y, 9)).mean() / 255), min(float(y.std()) / 73.9, 1.0), min(float(edges.var()) / 1000, 1.0), min(spread / 73.9, 1.0)


def frame_quality(frames: DataFrame) -> DataFrame:
    """``brightness, contrast, sharpness, color, blur, score`` of each frame; blur is the change since the frame before."""

    def one(data: bytes, w: int, h: int, before: list[bytes]) -> tuple:
        x = rgb_of(data, w, h).astype(np.float64)
        brightness, contrast, sharpness, color = quality_of(x)
        blur = min(float(np.abs(x - rgb_of(before[-1], w, h)).mean()) / 50, 1.0) if before and len(before[-1]) == len(data) else 0.0
        score = 0.15 * (1 - abs(brightness - 0.5) * 2) + 0.25 * contrast + 0.3 * sharpness + 0.15 * color + 0.15 * (1 - blur)
        return brightness, contrast, sharpness, color, blur, min(max(score, 0.0), 1.0)

    return with_history(frames, 1, one, "brightness double, contrast double, sharpness double, color double, blur double, score double")


def scene_distance(frames: DataFrame, bins: int = 32) -> DataFrame:
    """``distance``: half the chi-square distance of colour histograms (``bins`` a channel) to the frame before; 0 for the first."""

    def counts(data: bytes, w: int, h: int) -> np.ndarray:
        x = rgb_of(data, w, h).astype(np.int64) * bins // 256
        return np.bincount(((x[..., 0] * bins + x[..., 1]) * bins + x[..., 2]).ravel(), minlength=bins**3) / max(w * h, 1)

    def one(data: bytes, w: int, h: int, before: list[bytes]) -> tuple:
        if not before or not data:
            return (0.0,)
        a, b = counts(data, w, h), counts(before[-1], w, h)
        some = a + b > 0
        return (min(float(((a - b)[some] ** 2 / (a + b)[some]).sum()) / 2, 1.0),)

    return with_history(frames, 1, one, "distance double")


def importance(frames: DataFrame) -> DataFrame:
    """``motion, change, edges, score``: differences to the frame before (0 for the first) and the density of edges."""

    def one(data: bytes, w: int, h: int, before: list[bytes]) -> tuple:
        x = rgb_of(data, w, h)
        y = luma_of(x).astype(np.float64)
        motion = change = 0.0
        if before:
            z = rgb_of(before[-1], w, h)
            some = slice(None, None, 12)  # the first channel of every fourth pixel
            motion = min(float(np.abs(x.ravel()[some].astype(np.float64) - z.ravel()[some]).mean()) / 255, 1.0)
            a, b = (np.bincount(np.minimum(luma_of(v), 255).astype(np.int64).ravel(), minlength=256).astype(np.float64) for v in (z, x))
            some = a + b > 0
            change = min(float(((a - b)[some] ** 2 / (a + b)[some]).sum()) / 1000, 1.0)
        across, down = y[1:-1, 2:] - y[1:-1, :-2], y[2:, 1:-1] - y[:-2, 1:-1]
        edges = min(float(np.sqrt(across**2 + down**2).mean()) / 255, 1.0)
        return motion, change, edges, 0.4 * motion + 0.3 * change + 0.3 * edges

    return with_history(frames, 1, one, "motion double, change double, edges double, score double")


def temporal_denoise(frames: DataFrame, window: int, strength: float, threshold: float) -> DataFrame:
    """Mean over the last ``window`` frames, in which bytes that differ much weigh less; the first frame passes."""

    def one(data: bytes, w: int, h: int, before: list[bytes]) -> tuple:
        now = np.frombuffer(data, np.uint8).astype(np.float64)
        if not before:
            return w, h, data
        stack = np.stack([*(np.frombuffer(d, np.uint8).astype(np.float64) for d in before), now])
        d = np.abs(stack - now)
        weight = np.where(d < threshold, 1.0, 1 / (1 + d / threshold)) if threshold > 0 else 1.0 * (d == 0)
        mean = (stack * weight).sum(0) / weight.sum(0)
        made = np.clip(np.floor(np.round(now * (1 - strength) + mean * strength, 9) + 0.5), 0, 255)
        return w, h, made.astype(np.uint8).tobytes()

    return with_history(frames, window - 1, one, "width int, height int, data binary")


def freezes(frames: DataFrame, similarity: float = 0.999, least: int = 2) -> DataFrame:
    """``stream, start, stop``: runs in which each frame is as similar as that to the one before it.

    A run starts with the frame before its first such one and ends before the first that differs; one that lasts to the
    end of its stream is left out, as are runs of fewer than ``least`` repeats.
    """

    def one(data: bytes, w: int, h: int, before: list[bytes]) -> tuple:
        if not before or len(before[-1]) != len(data):
            return (False,)
        a, b = (np.frombuffer(d, np.uint8).astype(np.int64) for d in (data, before[-1]))
        return (bool(1 - np.abs(a - b).mean() / 255 >= similarity),)

    same = with_history(frames, 1, one, "same boolean")
    runs = islands(same, ["stream"], "frame_no", F.col("same"), least, drop_trailing=True)
    return runs.select("stream", (F.col("start") - 1).alias("start"), "stop")


def fades(luma: DataFrame, n: int, high: float = 0.3, low: float = 0.1) -> DataFrame:
    """``stream, start, stop``: every stretch of ``n`` frames (``stream, frame_no, luma``) that starts above ``high`` and ends below
    ``low``; the last one of a stream does not count.

    A stretch's two ends meet by their number, so that no frame is looked at in the order of a stream.
    """
    ends = luma.groupBy("stream").agg(F.max("frame_no").alias("_last"))
    later = luma.select("stream", (F.col("frame_no") - (n - 1)).alias("frame_no"), F.col("luma").alias("_end")).filter(F.col("_end") < low)
    hits = luma.filter(F.col("luma") > high).join(later, ["stream", "frame_no"]).join(ends, "stream")
    return hits.filter(F.col("frame_no") + n <= F.col("_last")).select("stream", F.col("frame_no").alias("start"), (F.col("frame_no") + n).alias("stop"))


def apply_cube(frames: DataFrame, size: int, table: list[tuple[float, float, float]], least: tuple[float, float, float] = (0.0, 0.0, 0.0), most: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """RGB frames through a table of ``size`` to the third colours (red runs fastest), interpolated along all three axes."""
    cube = np.array(table, np.float64).reshape(size, size, size, 3)  # blue, green, red
    low, span = np.array(least), np.array(most) - np.array(least)

    def run(data: bytes, w: int, h: int) -> tuple:
        x = rgb_of(data, w, h).reshape(-1, 3) / 255.0
        place = np.clip((x - low) / span, 0, 1) * (size - 1)
        base = np.minimum(place.astype(int), size - 2) if size > 1 else np.zeros(place.shape, int)
        part = place - base
        out = np.zeros_like(x)
        for corner in range(8):
            step = [corner >> k & 1 for k in range(3)]
            weight = np.prod([part[:, k] if step[k] else 1 - part[:, k] for k in range(3)], axis=0)
            at = [np.minimum(base[:, k] + step[k], size - 1) for k in range(3)]
            out += weight[:, None] * cube[at[2], at[1], at[0]]
        return w, h, np.clip(np.floor(np.round(out * 255, 6)), 0, 255).astype(np.uint8).tobytes()

    return map_frames(frames, run)


def sampled(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Another size (height x width, and channels if there are any), by bilinear samples from the upper left corner on."""
    h, w = x.shape[:2]
    sy, sx = np.arange(height) * h / height, np.arange(width) * w / width
    y0, x0 = sy.astype(int), sx.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    more = (1,) * (x.ndim - 2)
    fy, fx = (sy - y0).reshape(-1, 1, *more), (sx - x0).reshape(-1, *more)
    across = lambda rows: x[rows][:, x0] * (1 - fx) + x[rows][:, x1] * fx
    return across(y0) * (1 - fy) + across(y1) * fy


def truncated(x: np.ndarray) -> np.ndarray:
    """As bytes; what is a rounding error below a whole number counts as that number."""
    return np.floor(np.clip(np.round(x, 4), 0, 255))


def shrunk(data: bytes, w: int, h: int, to_width: int, to_height: int) -> np.ndarray:
    """Luma at a smaller size, truncated."""
    return truncated(sampled(luma_of(rgb_of(data, w, h)).astype(np.float64), to_width, to_height))


def fit(frames: DataFrame, width: int, height: int, mode: str = "fit", bar: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """RGB frames at another size.  ``stretch`` distorts them and ``fill`` cuts what stands out at the middle; ``letterbox`` and
    ``pillarbox`` put bars above and below or at the sides (each gives way to the other where the frame does not fit), and
    ``fit`` chooses between them by the aspect."""
    if mode not in ("fit", "fill", "stretch", "letterbox", "pillarbox"):
        raise ValueError(f"no fit mode {mode}")

    def run(data: bytes, w: int, h: int) -> tuple:
        x = rgb_of(data, w, h).astype(np.float64)
        wider = w / h > width / height
        by_width, by_height = (width, int(h * (width / w))), (int(w * (height / h)), height)
        if mode == "stretch":
            return width, height, truncated(sampled(x, width, height)).astype(np.uint8).tobytes()
        if mode == "fill":
            sw, sh = by_height if wider else by_width
            made = truncated(sampled(x, sw, sh))
            top, left = (sh - height) // 2, (sw - width) // 2
            return width, height, made[top : top + height, left : left + width].astype(np.uint8).tobytes()
        flat = wider if mode == "fit" else mode == "letterbox"
        if flat and by_width[1] > height:
            flat = False
        elif not flat and by_height[0] > width:
            flat = True
        sw, sh = by_width if flat else by_height
        out = np.empty((height, width, 3), np.uint8)
        out[:] = bar
        top, left = (height - sh) // 2, (width - sw) // 2
        out[top : top + sh, left : left + sw] = truncated(sampled(x, sw, sh))
        return width, height, out.tobytes()

    return map_frames(frames, run)


def bits_of(flags: np.ndarray) -> int:
    """A signed 64-bit number of 64 flags, the first the lowest."""
    return int(np.packbits(flags.ravel(), bitorder="little").view("<i8")[0])


def hashes(frames: DataFrame) -> DataFrame:
    """``average, difference, perceptual`` hashes of RGB frames: of 8x8 above the integer mean, of 9x8 less than the right
    neighbour, and of the low 8x8 block of the cosine transform of 32x32 above its upper median."""
    d = kernels.dct_matrix(32)[:8]

    def one(data: bytes, w: int, h: int) -> tuple:
        small, wide = shrunk(data, w, h, 8, 8), shrunk(data, w, h, 9, 8)
        low = np.round(d @ shrunk(data, w, h, 32, 32) @ d.T, 6).ravel()
        return bits_of(small > int(small.sum()) // 64), bits_of(wide[:, :-1] < wide[:, 1:]), bits_of(low > np.sort(low)[32])

    return measure_frames(frames, one, "average long, difference long, perceptual long")


def feathered(mask: np.ndarray, radius: int) -> np.ndarray:
    """Integer mean of the (2 radius + 1)^2 pixels around each pixel that has them all; others stay."""
    size = 2 * radius + 1
    out = mask.astype(np.int64)
    if min(mask.shape) >= size:
        total = np.pad(out.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        inner = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
        out = out.copy()
        out[radius : mask.shape[0] - radius, radius : mask.shape[1] - radius] = inner // size**2
    return out


# Drawing


#: A font of 3x5 dots for times, a row of five octal digits for each sign.
FONT = {"0": 0o75557, "1": 0o26227, "2": 0o71747, "3": 0o71717, "4": 0o55711, "5": 0o74717, "6": 0o74757, "7": 0o71111, "8": 0o75757, "9": 0o75717, ":": 0o02020, ";": 0o02024, ".": 0o00002}


def draw_text(x: np.ndarray, text: str, left: int, top: int, dot: int = 2, color: tuple[int, int, int] = (255, 255, 255)) -> None:
    """Draw the signs of ``FONT`` (a filled block for any other but the space) into an RGB array, cut at its edges."""
    for n, sign in enumerate(text):
        rows = FONT.get(sign, 0o77777 if sign != " " else 0)
        for r in range(5):
            for c in range(3):
                if rows >> (3 * (4 - r) + 2 - c) & 1:
                    y, z = top + r * dot, left + (4 * n + c) * dot
                    x[max(y, 0) : max(y + dot, 0), max(z, 0) : max(z + dot, 0)] = color


def overlay(frames: DataFrame, text: Column, left: int = 4, top: int = 4, dot: int = 2) -> DataFrame:
    """RGB frames with the text of each row (null or empty: none) drawn in: time codes, marks or the cue of the moment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, w, h, shown in _rows(b, "data", "width", "height", "_shown"):
                x = rgb_of(data, w, h).copy()
                draw_text(x, shown or "", left, top, dot)
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], b.schema.names[:5])

    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FRAME.split(", ")]
    return frames.select(*columns, text.cast("string").alias("_shown")).mapInArrow(run, FRAME)


def subtitled(frames: DataFrame, cues: DataFrame, rate: float, left: int = 4, top: int = 4, dot: int = 2, bucket: int = 10_000) -> DataFrame:
    """RGB frames, ``rate`` a second, with the texts of the cues (``stream, ordinal, start_ms, end_ms, text``) that stand when they are shown.

    Cues are found by an interval join of times alone, without the frames' bytes; several that stand together follow their order.
    """
    from .islands import interval_join

    times = frames.select(F.col("stream"), F.col("frame_no"), F.floor(F.col("frame_no") * 1000 / rate).alias("_ms"))
    met = interval_join(times, cues.select("stream", "ordinal", "start_ms", "end_ms", "text"), "stream", "_ms", "start_ms", "end_ms", bucket)
    shown = met.groupBy("stream", "frame_no").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_cues"))
    shown = shown.select(F.col("stream").alias("_s"), F.col("frame_no").alias("_f"), F.array_join(F.transform("_cues", lambda c: c["text"]), " ").alias("_text"))
    rows = frames.join(shown, (F.col("stream") == F.col("_s")) & (F.col("frame_no") == F.col("_f")), "left")
    return overlay(rows, F.col("_text"), left, top, dot)
