"""Synchronisation of two signals of each stream: lag search, spikes and drift.

The lag search reads a bounded head of both signals (``most`` samples of the reference and twice as many of the other),
so that a group never grows with a stream's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import dealt, ordered_fold
from .islands import near_join
from .linear import stretches

MOST_OFFSET, SPACING = 480_000, 4_800


def scores(reference: np.ndarray, search: np.ndarray, lags: int) -> np.ndarray:
    """Normalised dot products of the reference with the search signal from each of the lags on; 0 without energy.

    All dot products come from one FFT; those within its rounding of the largest are taken again directly, so that ties
    are exact for whole-numbered samples.
    """
    n = len(reference)
    if lags < 1 or not n:
        return np.zeros(0)
    search = search[: lags + n - 1]
    size = 1 << (len(search) + n).bit_length()
    dots = np.fft.irfft(np.fft.rfft(search, size) * np.conj(np.fft.rfft(reference, size)), size)[:lags]
    power = np.append(0.0, np.cumsum(search * search))
    denominator = np.sqrt((reference @ reference) * (power[n : n + lags] - power[:lags]))
    out = np.divide(dots, denominator, out=np.zeros(lags), where=denominator > 0)
    for lag in np.flatnonzero(out >= out.max() - 1e-6)[:1024].tolist():
        part = search[lag : lag + n]
        exact = np.sqrt((reference @ reference) * (part @ part))
        out[lag] = (reference @ part) / exact if exact > 0 else 0.0
    return out


def _signals(x: DataFrame, key: list[str], side: int, most: int) -> DataFrame:
    """The samples of a signal that a search can reach, and ahead of them (at -1) its length."""
    own = [F.col(k).cast("long").alias(k) for k in key]
    head = x.filter(F.col("i") < 2 * most).select(*own, F.lit(side).alias("_side"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("_x"))
    length = x.groupBy(*own).agg(F.count("*").cast("double").alias("_x"))
    return head.unionByName(length.select(*key, F.lit(side).alias("_side"), F.lit(-1).cast("long").alias("i"), "_x"))


def _searched(a: DataFrame, b: DataFrame, key: list[str], most: int, least: int, made: Callable[[np.ndarray, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``made`` of the scores and the sign of each key's search.

    The shorter signal is the reference, and the second of two equally long ones; the other is searched, up to the lag that
    leaves it the length of the reference, and at least ``least`` samples.  Both signals of a key come in one sorted pass;
    as in a join, a missing key meets nothing.
    """
    names = [*key, *(c.split()[0] for c in schema.split(", "))]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for (*own, side), _, x in stretches(batches, [*key, "_side"]):
            if not side:
                before = (own, x)
            elif before is not None and before[0] == own:
                (n, one), (m, two) = (before[1][0], before[1][1:]), (x[0], x[1:])
                reference, search, longer = (one, two, m) if n < m else (two, one, n)
                size = int(min(n, m, most))
                values = made(scores(reference[:size], search, int(min(longer - max(size, least), most))), -1 if n > m else 1)
                rows = len(next(iter(values.values())))
                if rows:
                    yield pa.RecordBatch.from_arrays([*[pa.array([k] * rows, pa.int64()) for k in own], *map(pa.array, values.values())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in found(batches):
            held.append(b)
            if sum(h.num_rows for h in held[-64:]) > 65536 or len(held) >= 1024:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    both = _signals(a, key, 0, most).unionByName(_signals(b, key, 1, most)).dropna(subset=key)
    return dealt(both, *key).sortWithinPartitions(*key, "_side", "i").mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", " + schema)


def lag_scores(a: DataFrame, b: DataFrame, most: int = MOST_OFFSET, key: tuple[str, ...] = ("stream",), least: int = 0) -> DataFrame:
    """The key, ``lag`` and ``score`` of every lag that is searched (``a`` and ``b``: the key, ``i``, ``x``)."""
    return _searched(a, b, list(key), most, least, lambda s, sign: {"lag": sign * np.arange(len(s)), "score": s}, "lag long, score double")


def sync_offset(a: DataFrame, b: DataFrame, most: int = MOST_OFFSET, key: tuple[str, ...] = ("stream",), least: int = 0) -> DataFrame:
    """The key, ``offset`` in samples and ``confidence`` (0 to 1): the first lag of the largest score.

    The offset is negative where ``a`` is the longer signal.  Without a lag to search both are 0, or there is no row if
    ``least`` samples are asked for; a key that one of the signals lacks gives no row.
    """

    def made(s: np.ndarray, sign: int) -> dict[str, np.ndarray]:
        if least and not len(s):
            return {"offset": np.zeros(0, np.int64), "confidence": np.zeros(0)}
        best = int(s.argmax()) if len(s) else 0
        return {"offset": np.array([sign * best]), "confidence": np.array([min(max((s[best] + 1) / 2, 0.0), 1.0) if len(s) else 0.0])}

    return _searched(a, b, list(key), most, least, made, "offset long, confidence double")


class _Spaced:
    """Greedy spacing: a place is taken if it is more than ``spacing`` after the last one taken (or the start)."""

    def __init__(self, spacing: int):
        self.spacing, self.last = spacing, 0

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        at = rows.column(rows.schema.get_field_index("i")).to_numpy()
        keep, k = [], 0
        while (k := k + int(np.searchsorted(at[k:], self.last + self.spacing, "right"))) < len(at):
            keep.append(k)
            self.last = int(at[k])
        return rows.take(pa.array(keep, pa.int64()))

    def finish(self) -> None:
        return None


def spikes(samples: DataFrame, share: float = 0.8, spacing: int = SPACING) -> DataFrame:
    """``stream, i, amplitude, confidence``: local peaks above a share of the stream's largest magnitude, spaced greedily.

    A peak exceeds both neighbours in magnitude (a missing one does not count).  Silent streams have none.
    """
    size = F.abs(F.col("x").cast("long"))
    order = W.partitionBy("stream").orderBy("i")
    top = samples.groupBy("stream").agg(F.max(size).alias("_top"))
    rows = samples.select("stream", "i", size.alias("amplitude"))
    rows = rows.withColumn("_l", F.lag("amplitude").over(order)).withColumn("_r", F.lead("amplitude").over(order))
    peak = lambda c: F.col(c).isNull() | (F.col("amplitude") > F.col(c))
    found = rows.filter(peak("_l") & peak("_r")).join(top, "stream").filter((F.col("_top") > 0) & (F.col("amplitude") > F.col("_top") * share))
    found = found.select(F.col("stream").cast("long").alias("stream"), F.col("i").cast("long").alias("i"), "amplitude", (F.col("amplitude") / F.col("_top")).alias("confidence"))
    return ordered_fold(found, ["stream"], ["i"], lambda _: _Spaced(spacing), "stream long, i long, amplitude long, confidence double")


def spike_offset(a: DataFrame, b: DataFrame, most: int = MOST_OFFSET) -> DataFrame:
    """``stream, offset, confidence`` from the spikes of two signals: the pair within ``most`` samples whose product of
    confidences is largest, the first of equals by the places of ``a`` and ``b``.

    Streams with spikes in both but no pair so near have 0 and 0; streams without spikes in one give no row.
    """
    near = near_join(a.select("stream", "i", "confidence"), b.select("stream", "i"), "stream", "i", most)
    other = b.select("stream", F.col("i").alias("other"), F.col("confidence").alias("_c"))
    pairs = near.join(other, ["stream", "other"]).withColumn("_p", F.col("confidence") * F.col("_c"))
    best = pairs.groupBy("stream").agg(F.max_by(F.struct((F.col("other") - F.col("i")).alias("offset"), F.col("_p").alias("confidence")), F.struct("_p", -F.col("i"), -F.col("other"))).alias("_b"))
    both = a.select("stream").distinct().join(b.select("stream").distinct(), "stream")
    return both.join(best, "stream", "left").select("stream", F.coalesce("_b.offset", F.lit(0)).alias("offset"), F.coalesce("_b.confidence", F.lit(0.0)).alias("confidence"))


def drift(a: DataFrame, b: DataFrame, segment: int = 30 * 48_000, most: int = MOST_OFFSET, segments: int = 10, sure: float = 0.5) -> DataFrame:
    """``stream, drift``: samples of offset gained per sample, by the slope over the first segments' offsets.

    Only offsets with more than ``sure`` confidence count; with fewer than two the drift is 0.  The last segment is cut to
    the shorter signal, and the search ends with one cut below half.  A first signal of less than two segments is
    too short: its drift is null.
    """
    n = lambda x, name: x.groupBy("stream").agg(F.count("*").alias(name))
    sized = n(a, "_n").join(n(b, "_m"), "stream")
    number: Column = F.expr(f"i div {segment}")
    end = F.least((F.col("seg") + 1) * segment, "_n", "_m")

    def cut(x: DataFrame) -> DataFrame:
        rows = x.withColumn("seg", number).join(sized, "stream").filter((F.col("seg") < segments) & (F.col("seg") < F.floor(F.col("_n") / segment)))
        rows = rows.filter((F.col("i") < end) & (end - F.col("seg") * segment >= segment // 2))
        return rows.select(F.col("stream").cast("long").alias("stream"), F.col("seg").cast("long").alias("seg"), (F.col("i") - F.col("seg") * segment).alias("i"), "x")

    found = sync_offset(cut(a), cut(b), most, ("stream", "seg")).filter(F.col("confidence") > sure)
    slopes = found.groupBy("stream").agg(F.when(F.count("*") > 1, F.regr_slope("offset", "seg") / segment).otherwise(0.0).alias("_d"))
    return sized.join(slopes, "stream", "left").select("stream", F.when(F.col("_n") >= 2 * segment, F.coalesce("_d", F.lit(0.0))).alias("drift"))
