"""Sample-format and rate conversion of audio streams, in blocks of a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audio import clamp16, truncate
from .linear import stretches


#: Outputs of a block.
BLOCK = 65536


def converted(x: np.ndarray, first: int, places: np.ndarray, method: str, window: int) -> np.ndarray:
    """Values between samples at places that are counted from the stream's beginning; ``x`` begins with sample ``first``."""
    own = lambda k: np.clip(k - first, 0, len(x) - 1)  # noqa: E731  beyond a stream's ends its last samples
    if method == "nearest":
        return x[own(np.floor(places + 0.5).astype(np.int64))]
    base = np.floor(places).astype(np.int64)
    if method == "linear":
        return np.interp(places - first, np.arange(len(x)), x)
    total, weight = np.zeros(len(places)), np.zeros(len(places))
    for k in range(1 - window, window + 1):
        d = places - (base + k)
        w = np.sinc(d) * np.sinc(d / window)
        total += w * x[own(base + k)]
        weight += w
    return total / weight


def convert(samples: DataFrame, rate: int, to_rate: int, method: str = "sinc", window: int = 8, block: int = BLOCK) -> DataFrame:
    """``stream, i, y`` at the new rate; methods: nearest, linear, sinc (Lanczos over ``window`` samples on each side).

    ``i`` counts each stream's samples from 0.  Outputs are made in blocks; a sample goes to each block that it reaches,
    those near an edge to both, so that a stream is spread over many tasks.
    """
    reach = window if method == "sinc" else 1
    first, last = F.expr(f"greatest((i - {reach}) * {to_rate} div {rate}, 0L) div {block}"), F.expr(f"((i + {reach}) * {to_rate} div {rate} + 1) div {block}")
    rows = samples.select(F.col("stream").cast("long").alias("stream"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("_x")).withColumn("_b", F.explode(F.sequence(first, last)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (stream, number), places, x in stretches(batches, ["stream", "_b"]):
            start, stop = number * block, (number + 1) * block
            if int(places[-1]) < (stop - 1) * rate // to_rate + reach:  # the stream ends here
                stop = min(stop, (int(places[-1]) + 1) * to_rate // rate)
            k = np.arange(start, stop)
            y = converted(x, int(places[0]), k * rate / to_rate, method, window)
            yield pa.RecordBatch.from_arrays([pa.array([stream] * len(k), pa.int64()), pa.array(k), pa.array(y)], ["stream", "i", "y"])

    return rows.repartition("stream", "_b").sortWithinPartitions("stream", "_b", "i").mapInArrow(run, "stream long, i long, y double")


def low_pass(length: int, up: int) -> np.ndarray:
    """A windowed (Hamming) sinc with the cut-off of an ``up``-fold rate, normalised."""
    n = np.arange(length) - (length - 1) / 2
    h = np.sinc(n / up) / up * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(length) / (length - 1)))
    return h / h.sum()


def polyphase(samples: DataFrame, rate: int, to_rate: int, taps_each: int = 64) -> DataFrame:
    """``stream, i, y``: output ``k`` sums the taps that are multiples of the lower rate's step over the samples that stood there.

    Only so many samples take part as the filter spans, so that each sample is sent to the outputs it reaches and
    nothing is held by stream.
    """
    step = math.gcd(rate, to_rate)
    up, down = to_rate // step, rate // step
    taps = low_pass(taps_each * up, up)[::down].tolist()
    # sample i stands at the places t = k * down with t div up = i
    first, last = F.expr(f"cast(ceil(i * {up} / {down}) as bigint)"), F.expr(f"cast(ceil((i + 1) * {up} / {down}) as bigint) - 1")
    placed = samples.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    order = W.partitionBy("stream").orderBy("_k")
    terms = [F.coalesce(F.lag("x", j).over(order), F.lit(0)) * tap for j, tap in enumerate(taps)]
    return placed.select("stream", F.col("_k").alias("i"), sum(terms[1:], terms[0]).alias("y"))


def decode_pcm(data: Column) -> Column:
    """Signed 16-bit little-endian samples of a packet as an array; an odd number of bytes is an error."""
    pairs = F.sequence(F.lit(0), F.greatest(F.octet_length(data) / 2 - 1, F.lit(0)).cast("int"))

    def one(k: Column) -> Column:
        pair = F.hex(F.substring(data, 2 * k + 1, F.lit(2)))
        value = F.conv(F.concat(F.substring(pair, 3, 2), F.substring(pair, 1, 2)), 16, 10).cast("int")
        return F.when(value > 32767, value - 65536).otherwise(value)

    checked = F.when(F.octet_length(data) % 2 != 0, F.raise_error(F.lit("odd number of bytes")).cast("array<int>"))
    return checked.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(pairs, one))


def encode_pcm(samples: Column) -> Column:
    """The inverse of ``decode_pcm``, clamped to 16 bits."""

    def one(x: Column) -> Column:
        text = F.lpad(F.hex(F.pmod(clamp16(x), F.lit(65536)).cast("long")), 4, "0")
        return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))

    return F.unhex(F.array_join(F.transform(samples, one), ""))


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / 32768.0)


def from_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: truncate(clamp16(x * 32768.0)).cast("int"))


#: Numpy types of sample formats by name; three-byte samples are widened first.
PCM = {"u8": "u1", "s8": "i1", "s16le": "<i2", "s16be": ">i2", "s24le": "<i4", "s24be": ">i4", "s32le": "<i4", "s32be": ">i4", "f32le": "<f4", "f32be": ">f4", "f64le": "<f8", "f64be": ">f8"}


def _checked(kind: str) -> str:
    if kind not in PCM:
        raise ValueError(f"no sample format {kind}")
    return kind


def unpacked(data: bytes, kind: str) -> np.ndarray:
    """Samples of a packet as doubles from -1 to 1 (unsigned ones around their middle); a broken last sample is an error."""
    if kind.startswith("s24"):
        if len(data) % 3:
            raise ValueError("bytes left over behind the last sample")
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, slice(1, 4) if kind == "s24le" else slice(0, 3)] = raw
        return wide.view(PCM[kind]).ravel() / 2.0**31
    dtype = np.dtype(PCM[kind])
    if len(data) % dtype.itemsize:
        raise ValueError("bytes left over behind the last sample")
    x = np.frombuffer(data, dtype)
    return x.astype(np.float64) if dtype.kind == "f" else (x.astype(np.float64) - (128 if kind == "u8" else 0)) / 2.0 ** (8 * dtype.itemsize - 1)


def packed(samples: np.ndarray, kind: str) -> bytes:
    """The inverse, truncated and clamped to what the format holds."""
    dtype = np.dtype(PCM[kind])
    if dtype.kind == "f":
        return samples.astype(dtype).tobytes()
    bits = 24 if kind.startswith("s24") else 8 * dtype.itemsize
    top = 2.0 ** (bits - 1)
    whole = np.clip(np.trunc(samples * top), -top, top - 1).astype(np.int64)
    if kind == "u8":
        return (whole + 128).astype(np.uint8).tobytes()
    if bits == 24:
        raw = whole.astype(PCM[kind]).view(np.uint8).reshape(-1, 4)
        return np.ascontiguousarray(raw[:, :3] if kind == "s24le" else raw[:, 1:]).tobytes()
    return whole.astype(dtype).tobytes()


def decode_samples(data: Column, kind: str) -> Column:
    """Samples of packets in any PCM format as an array of doubles; a null packet gives null."""
    _checked(kind)

    @F.pandas_udf("array<double>")
    def run(packets: pd.Series) -> pd.Series:
        return packets.map(lambda d: None if d is None else unpacked(bytes(d), kind))

    return run(data)


def encode_samples(samples: Column, kind: str) -> Column:
    """Packets in any PCM format of arrays of doubles."""
    _checked(kind)

    @F.pandas_udf("binary")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: None if x is None else packed(np.asarray(x, np.float64), kind))

    return run(samples)
