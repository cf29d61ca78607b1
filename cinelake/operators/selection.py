"""Choosing frames: fingerprints of streams, thumbnails, and the best of several versions.

``frames`` are ``stream, frame_no`` (counting up from 0) with scores, times or hashes; a stream's choice never holds
more than the frames that are chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(frames: DataFrame, n: int) -> DataFrame:
    """``n`` frames at even steps over the first 2 n frames (all of them if there are no more than ``n``)."""
    kept = F.least(F.count("*").over(W.partitionBy("stream")), F.lit(2 * n))
    step = F.greatest(kept / n, F.lit(1.0))
    # frame k is taken if it is the whole part of some multiple of the step
    at = F.ceil(F.col("frame_no") / F.col("_step"))
    rows = frames.withColumn("_kept", kept).withColumn("_step", step).filter(F.col("frame_no") < F.col("_kept"))
    return rows.filter((at < n) & (F.floor(at * F.col("_step")) == F.col("frame_no"))).drop("_kept", "_step")


def top(frames: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The ``n`` frames of each stream with the highest scores, the earlier of equals, with their ``place`` from 0."""
    order = W.partitionBy("stream").orderBy(F.col(score).desc(), "frame_no")
    return frames.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n)


def adaptive(frames: DataFrame, threshold: float, least: int, most: int, score: str = "score") -> DataFrame:
    """The first ``least`` frames and those that reach the threshold; of more than ``most``, the best of them."""
    own = W.partitionBy("stream").orderBy("frame_no")
    some = frames.withColumn("_k", F.row_number().over(own)).filter((F.col("_k") <= least) | (F.col(score) >= threshold))
    return top(some.drop("_k"), most, score).drop("place")


def fingerprints(chosen: DataFrame, hash_col: str = "hash", order: str = "place") -> DataFrame:
    """``stream, hashes``: the hashes of each stream's chosen frames in their order."""
    listed = F.array_sort(F.collect_list(F.struct(order, hash_col)))
    return chosen.groupBy("stream").agg(F.transform(listed, lambda x: x[hash_col]).alias("hashes"))


def list_distance(a: Column, b: Column) -> Column:
    """Differing bits of two lists of hashes place by place; null for lists of unequal length, which do not compare."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), bits)


def list_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits; 0 for lists that do not compare, and not a number for empty ones."""
    share = F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(1 - list_distance(a, b) / F.nullif(F.size(a) * 64, F.lit(0)))
    return F.when(F.size(a) == F.size(b), share).otherwise(0.0)


def best_by(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The row of each key with the highest value, the last of equals."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(value, ordinal)).alias("_r")).select("_r.*")


def representative(quality: DataFrame) -> DataFrame:
    """``stream, frame_no``: the frame nearest to the upper medians of ``brightness`` and ``contrast`` of its stream.

    Distances are compared in whole thousandths; the first of equals is taken.
    """

    def median(c: str) -> DataFrame:
        order = W.partitionBy("stream").orderBy(c, "frame_no")
        placed = quality.select("stream", c, (F.row_number().over(order) - 1).alias("_k"), F.count("*").over(W.partitionBy("stream")).alias("_n"))
        return placed.filter(F.col("_k") == F.expr("_n div 2")).select("stream", F.col(c).alias(f"_{c}"))

    rows = quality.join(median("brightness"), "stream").join(median("contrast"), "stream")
    away = F.floor(F.round((F.abs(F.col("brightness") - F.col("_brightness")) + F.abs(F.col("contrast") - F.col("_contrast"))) * 1000, 6))
    return rows.groupBy("stream").agg(F.min_by("frame_no", F.struct(away, F.col("frame_no"))).alias("frame_no"))


def thumbnail(frames: DataFrame, method: str, value: float | None = None) -> DataFrame:
    """``stream, frame_no`` of a stream's thumbnail: ``first``, ``middle``, ``timestamp`` (the frame whose ``time`` is nearest to
    the value in whole milliseconds, the first of equals), ``index`` (the value; beyond the stream is an error), ``smart``
    (the best ``score``, the last of equals) or ``representative``."""
    by = frames.groupBy("stream")
    if method == "first":
        return by.agg(F.min("frame_no").alias("frame_no"))
    if method == "middle":
        return by.agg(F.expr("count(*) div 2").alias("frame_no"))
    if method == "timestamp":
        away = F.floor(F.round(F.abs(F.col("time") - F.lit(float(value))) * 1000, 6))
        return by.agg(F.min_by("frame_no", F.struct(away, F.col("frame_no"))).alias("frame_no"))
    if method == "index":
        at = int(value)
        return by.agg(F.when(F.count("*") > at, F.lit(at)).otherwise(F.raise_error(F.lit(f"no frame {at}")).cast("int")).cast("long").alias("frame_no"))
    if method == "smart":
        return by.agg(F.max_by("frame_no", F.struct("score", "frame_no")).alias("frame_no"))
    if method == "representative":
        return representative(frames)
    raise ValueError(f"no thumbnail method {method}")
