"""Filters and meters with feedback.

Linear ones (equaliser, K-weighting, VU meter) are split within a stream (``linear``).  Those whose coefficients depend on the
signal (envelopes, peak hold) are one ordered pass over each stream, whose state goes from batch to batch: there a stream is
the unit of distribution, a batch of samples the unit of memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold
from .linear import biquad, cascade, linear_filter, smoothing

#: Maps the next samples of a stream to as many outputs; what it holds back it returns after the last (for None).
Filter = Callable[[np.ndarray | None], np.ndarray]


class _PerSample:
    """The fold of a filter: outputs go out under the places of their samples."""

    def __init__(self, key: tuple, names: list[str], f: Filter):
        self.key, self.names, self.f = key, names, f
        self.places = np.zeros(0, np.int64)

    def _out(self, y: np.ndarray) -> pa.RecordBatch:
        at, self.places = self.places[: len(y)], self.places[len(y) :]
        keys = [pa.array(np.full(len(y), k, np.int64)) for k in self.key]
        return pa.RecordBatch.from_arrays([*keys, pa.array(at), pa.array(y)], self.names)

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        i, x = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("i", "x"))
        self.places = np.append(self.places, i)
        return self._out(self.f(x.astype(np.float64) / 32768.0))

    def finish(self) -> pa.RecordBatch:
        return self._out(self.f(None))


def per_stream(samples: DataFrame, make: Callable[[], Filter], name: str, key: tuple[str, ...] = ("stream",)) -> DataFrame:
    """The key, ``i`` and a double for each sample of each stream, ordered by ``i``; ``make`` gives each stream its filter."""
    names = [*key, "i", name]
    rows = samples.select(*[F.col(k).cast("long").alias(k) for k in key], F.col("i").cast("long").alias("i"), "x")
    return ordered_fold(rows, list(key), ["i"], lambda own: _PerSample(own, names, make()), ", ".join(f"{k} long" for k in [*key, "i"]) + f", {name} double")


def chain(*filters: Filter) -> Filter:
    """Filters one after the other; none of them holds samples back."""

    def run(x: np.ndarray | None) -> np.ndarray:
        y = np.zeros(0) if x is None else x
        for f in filters:
            y = f(y)
        return y

    return run


class Level:
    """A smoothed magnitude: it rises with one coefficient and falls with another."""

    def __init__(self, rising: float, falling: float):
        self.rising, self.falling, self.level = rising, falling, 0.0

    def __call__(self, x: np.ndarray | None) -> np.ndarray:
        values = np.zeros(0) if x is None else np.abs(x)
        out, level = np.empty_like(values), self.level
        for k, v in enumerate(values.tolist()):
            c = self.rising if v > level else self.falling
            level = c * level + (1 - c) * v
            out[k] = level
        self.level = level
        return out


def coefficient(rate: int, ms: float) -> float:
    return math.exp(-1000.0 / (rate * ms))


def vu_meter(samples: DataFrame, rate: int = 48_000, ms: float = 300.0) -> DataFrame:
    """Ballistics of a VU meter: attack and release have one time constant."""
    return linear_filter(samples, smoothing(coefficient(rate, ms)), "vu", magnitude=True)


class PeakHold:
    """Peaks of whole blocks, each for all its samples; a block that is not full yet is held back."""

    def __init__(self, block: int, hold: int, decay: float):
        self.block, self.hold, self.decay = block, hold, decay
        self.peak, self.left, self.rest = 0.0, 0, np.zeros(0)

    def __call__(self, x: np.ndarray | None) -> np.ndarray:
        values = np.append(self.rest, np.zeros(0) if x is None else np.abs(x))
        end = len(values) if x is None else len(values) // self.block * self.block
        self.rest = values[end:]
        out = np.empty(end)
        for i in range(0, end, self.block):
            now = float(values[i : min(i + self.block, end)].max())
            if now >= self.peak:
                self.peak, self.left = now, self.hold
            elif self.left > 0:
                self.left -= self.block
            else:
                self.peak *= self.decay
            out[i : i + self.block] = self.peak
        return out


def peak_hold(samples: DataFrame, block: int, hold: int, decay: float) -> DataFrame:
    """Block peaks that are held for ``hold`` samples and then fall by a factor a block."""
    return per_stream(samples, lambda: PeakHold(block, hold, decay), "peak")


Coefficients = tuple[tuple[float, float, float], tuple[float, float]]


class Biquad:
    def __init__(self, b: tuple[float, float, float], a: tuple[float, float]):
        self.b, self.a = b, a
        self.state = (0.0, 0.0, 0.0, 0.0)

    def __call__(self, x: np.ndarray | None) -> np.ndarray:
        values = np.zeros(0) if x is None else x
        out = np.empty_like(values)
        x1, x2, y1, y2 = self.state
        (b0, b1, b2), (a1, a2) = self.b, self.a
        for k, v in enumerate(values.tolist()):
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, v, y1, y
            out[k] = y
        self.state = (x1, x2, y1, y2)
        return out


def peaking(rate: int, hz: float, gain_db: float, q: float) -> Coefficients:
    """Coefficients of a peaking equaliser."""
    amp, w = 10 ** (gain_db / 40), 2 * math.pi * hz / rate
    alpha, cos = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha / amp
    return ((1 + alpha * amp) / a0, -2 * cos / a0, (1 - alpha * amp) / a0), (-2 * cos / a0, (1 - alpha / amp) / a0)


def parametric_eq(samples: DataFrame, bands: list[tuple[float, float, float]], rate: int = 48_000) -> DataFrame:
    """A cascade of peaking filters, each (Hz, dB, Q)."""
    return linear_filter(samples, cascade(*[biquad(*peaking(rate, *band)) for band in bands]), "y")


def envelope(rate: int, attack_ms: float, release_ms: float) -> Level:
    return Level(coefficient(rate, attack_ms), coefficient(rate, release_ms))


def gain_curve(db: np.ndarray, threshold: float, ratio: float, knee: float) -> np.ndarray:
    """Decibels of gain of a soft-knee compressor at input levels."""
    over = db - threshold
    soft = (1 / ratio - 1) * (over + knee / 2) ** 2 / (2 * knee) if knee > 0 else np.zeros_like(db)
    hard = (1 / ratio - 1) * over
    return np.where(2 * over < -knee, 0.0, np.where((2 * np.abs(over) <= knee) & (knee > 0), soft, hard))


def decibels(x: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(x, 1e-10))


def driven(level: Filter, gain_db: Callable[[np.ndarray], np.ndarray]) -> Filter:
    """Samples times the gain, in decibels, that a level (also in decibels) calls for."""

    def run(x: np.ndarray | None) -> np.ndarray:
        x = np.zeros(0) if x is None else x
        return x * 10 ** (gain_db(decibels(level(x))) / 20)

    return run


def compressor(samples: DataFrame, threshold: float = -20.0, ratio: float = 4.0, knee: float = 6.0, attack_ms: float = 5.0, release_ms: float = 50.0, makeup: float = 0.0, rate: int = 48_000) -> DataFrame:
    return per_stream(samples, lambda: driven(envelope(rate, attack_ms, release_ms), lambda db: gain_curve(db, threshold, ratio, knee) + makeup), "y")


def limiter(samples: DataFrame, ceiling: float = -1.0, rate: int = 48_000) -> DataFrame:
    """A compressor with a steep ratio, no knee and a fast attack."""
    return compressor(samples, ceiling, 100.0, 0.0, 0.1, 50.0, 0.0, rate)


def expander(samples: DataFrame, threshold: float = -40.0, ratio: float = 2.0, attack_ms: float = 5.0, release_ms: float = 50.0, rate: int = 48_000) -> DataFrame:
    """Below the threshold the gain falls by the distance times (ratio - 1) / ratio decibels."""
    below = lambda db: -np.maximum(threshold - db, 0.0) * (ratio - 1) / ratio
    return per_stream(samples, lambda: driven(envelope(rate, attack_ms, release_ms), below), "y")


def de_esser(samples: DataFrame, hz: float = 6000.0, q: float = 2.0, boost: float = 12.0, threshold: float = -20.0, ratio: float = 4.0, rate: int = 48_000) -> DataFrame:
    """The level of the boosted band drives the gain of the whole signal."""
    band = lambda: chain(Biquad(*peaking(rate, hz, boost, q)), envelope(rate, 1.0, 50.0))
    return per_stream(samples, lambda: driven(band(), lambda db: gain_curve(db, threshold, ratio, 6.0)), "y")


def k_weights(rate: int) -> tuple[Coefficients, Coefficients]:
    """A high pass at 80 Hz, and a shelf of four decibels from 1500 Hz on, by bilinear transform."""

    def warped(hz: float) -> tuple[float, float, float]:
        k, q = math.tan(math.pi * hz / rate), 0.707
        return k, k / q, 1 / (1 + k / q + k * k)

    k, damp, norm = warped(80.0)
    high = ((norm, -2 * norm, norm), (2 * (k * k - 1) * norm, (1 - damp + k * k) * norm))
    k, damp, norm = warped(1500.0)
    amp = 10 ** (4.0 / 40)
    slope = math.sqrt(amp) * damp
    shelf = (((amp + slope + k * k) * norm, 2 * (k * k - amp) * norm, (amp - slope + k * k) * norm), (2 * (k * k - 1) * norm, (1 - damp + k * k) * norm))
    return high, shelf


def k_weighted(samples: DataFrame, rate: int = 48_000, key: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Samples after both stages of the K-weighting, each stream (and channel) with a state of its own."""
    return linear_filter(samples, cascade(*[biquad(*c) for c in k_weights(rate)]), "y", key)
