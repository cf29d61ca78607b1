"""Camera trajectories (``stream, idx, dx, dy, angle, scale``) and grids of output frames over source frames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import ordered_fold
from .islands import centered

PARTS = ("dx", "dy", "angle", "scale")


def smooth(trajectory: DataFrame, window: int, strength: float) -> DataFrame:
    """Each transform moved by ``strength`` towards the mean of the ``window`` around it (cut at the ends)."""
    over = centered(["stream"], "idx", window)
    return trajectory.select("stream", "idx", *[(F.col(c) + (F.avg(c).over(over) - F.col(c)) * strength).alias(c) for c in PARTS])


class _LowPass:
    def __init__(self, key: tuple, strength: float):
        self.strength, self.now = strength, None

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        columns = [rows.column(rows.schema.get_field_index(c)).to_pylist() for c in PARTS]
        out = []
        for values in zip(*columns, strict=True):
            self.now = values if self.now is None else tuple((1 - self.strength) * v + self.strength * n for v, n in zip(values, self.now, strict=True))
            out.append(self.now)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *[pa.array([r[k] for r in out], pa.float64()) for k in range(4)]], ["stream", "idx", *PARTS])

    def finish(self) -> None:
        return None


def low_pass(trajectory: DataFrame, strength: float) -> DataFrame:
    """Exponential smoothing: what is kept of the transform before is ``strength``; the first one passes."""
    rows = trajectory.select(F.col("stream").cast("long").alias("stream"), F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in PARTS])
    return ordered_fold(rows, ["stream"], ["idx"], lambda key: _LowPass(key, strength), "stream long, idx long, dx double, dy double, angle double, scale double")


def stabilizing(trajectory: DataFrame, smoothed: DataFrame) -> DataFrame:
    """The transform that takes each frame from its own place to the smoothed one."""
    own = trajectory.select("stream", "idx", *[F.col(c).alias(f"_{c}") for c in PARTS])
    return smoothed.join(own, ["stream", "idx"]).select("stream", "idx", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in PARTS[:3]], (F.col("scale") / F.nullif(F.col("_scale"), F.lit(0.0))).alias("scale"))


def crop_of(width: Column, height: Column, percent: float) -> Column:
    """What stays of a frame of which a percentage is cut to hide the borders of stabilised frames."""
    x, y = (F.floor(side * percent / 200).cast("int") for side in (width, height))
    return F.struct(x.alias("x"), y.alias("y"), (width - 2 * x).alias("width"), (height - 2 * y).alias("height"))


def scanline(motion: DataFrame, height: int, readout: float) -> DataFrame:
    """``stream, idx, row`` and the part of a frame's motion that each row of pixels has seen (``readout``: of a frame's time)."""
    part = F.col("row") / height * min(max(readout, 0.0), 1.0)
    rows = motion.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.select("stream", "idx", "row", *[(F.col(c) * part).alias(c) for c in PARTS[:3]], (1 + (F.col("scale") - 1) * part).alias("scale"))


#: How often each frame of a cycle is repeated.
PULLDOWN = {"3:2": (3, 2, 3, 2), "2:2": (2, 2), "2:3:3:2": (2, 3, 3, 2)}


def inverse_pulldown(frames: DataFrame, cadence: str = "3:2", at: str = "frame_no") -> DataFrame:
    """The first frame of each repeat, by a stride that depends on the place in the cycle alone.

    The places are periodic from the first one on whose place in the cycle comes again, so that they are a filter of rows.
    """
    pattern = PULLDOWN[cadence]
    seen: dict[int, int] = {}
    places, i = [], 0
    while i % len(pattern) not in seen:
        seen[i % len(pattern)] = i
        places.append(i)
        i += pattern[i % len(pattern)]
    start = seen[i % len(pattern)]
    within = [p - start for p in places if p >= start]
    n = F.col(at)
    return frames.filter(n.isin(places) | ((n >= start) & ((n - start) % (i - start)).isin(within)))


def slow_motion_grid(sources: DataFrame, factor: float, key: str = "stream") -> DataFrame:
    """``out_frame, low, high, part`` for each key's frames (``n`` of them) played at ``factor`` (above 0, at most 1) of the speed."""
    if not 0 < factor <= 1:
        raise ValueError("the factor is above 0 and at most 1")
    count = F.round(F.col("n") / factor).cast("long")
    grid = sources.filter(count > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("out_frame"))
    place = F.col("out_frame") * factor
    low = F.floor(place)
    return grid.select(key, "out_frame", low.alias("low"), (low + 1).alias("high"), (place - low).alias("part"))


def rate_grid(sources: DataFrame, rate: int, to_rate: int, key: str = "stream") -> DataFrame:
    """``out_frame, low, high, part`` for each key's frames (``n`` of them) at another rate; the last frame stands in for what follows it."""
    count = F.expr(f"n * {to_rate} div {rate}")
    grid = sources.filter(count > 0).select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("out_frame"))
    low = F.expr(f"out_frame * {rate} div {to_rate}")
    return grid.select(key, "out_frame", low.alias("low"), F.least(low + 1, F.col("n") - 1).alias("high"), (F.col("out_frame") * rate / to_rate - low).alias("part"))


def pulldown(frames: DataFrame, cadence: str = "3:2", at: str = "frame_no") -> DataFrame:
    """Each frame as often as its place in the cycle says, with the number of the ``copy``."""
    pattern = PULLDOWN[cadence]
    times = F.element_at(F.array(*map(F.lit, pattern)), (F.col(at) % len(pattern) + 1).cast("int"))
    return frames.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), (times - 1).cast("long"))))


def stability(frames: DataFrame, value: str = "motion", order: Sequence[str] = ("idx",)) -> DataFrame:
    """``stream, mean, most, smoothness`` of a motion: the smoother, the less it changes from frame to frame."""
    step = F.col(value) - F.lag(value).over(W.partitionBy("stream").orderBy(*order))
    rows = frames.select("stream", F.col(value).alias("_v"), step.alias("_d"))
    return rows.groupBy("stream").agg(F.avg("_v").alias("mean"), F.max("_v").alias("most"), (1 / (1 + F.coalesce(F.avg(F.col("_d") * F.col("_d")), F.lit(0.0)))).alias("smoothness"))
