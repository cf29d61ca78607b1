"""Audio operators over samples (``stream``, ``i``, ``x`` as signed 16-bit integers): levels, detection, loudness.

What is linear or windowed is expressed in column functions.  Filters with feedback (:mod:`.dsp`) run once per stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dsp import k_weighted
from .islands import islands, trailing

LEAST, MOST = -32768, 32767


def clamp16(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LEAST)), F.lit(MOST))


def truncate(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def volume(samples: DataFrame, gain: float) -> DataFrame:
    return samples.withColumn("x", truncate(clamp16(F.col("x") * F.lit(gain))).cast("int"))


def silence(samples: DataFrame, threshold: int, least: int) -> DataFrame:
    return islands(samples, ["stream"], "i", F.abs("x") < threshold, least)


def chunks(samples: DataFrame, size: int) -> DataFrame:
    """Non-overlapping chunks with the sum of squares and the count; the last may be short."""
    return samples.groupBy("stream", F.expr(f"i div {size}").alias("chunk")).agg(F.sum(F.col("x").cast("long") * F.col("x")).alias("energy"), F.count("*").alias("n"))


def rms_silence(samples: DataFrame, size: int, threshold: int, least: int) -> DataFrame:
    """Runs of quiet chunks, in samples; a run that lasts to the end is dropped."""
    quiet = F.col("energy") < F.col("n") * threshold * threshold
    runs = islands(chunks(samples, size), ["stream"], "chunk", quiet, least, drop_trailing=True)
    return runs.select("stream", (F.col("start") * size).alias("start"), (F.col("stop") * size).alias("stop"))


def rms_normalize(samples: DataFrame, target: float, frame: int | None = None) -> DataFrame:
    """Gain of target over the RMS of each frame of so many samples (None: of the whole stream); under a thousandth all passes."""
    key = ["stream"] if frame is None else ["stream", "_f"]
    rows = samples if frame is None else samples.withColumn("_f", F.expr(f"i div {frame}"))
    whole = rows.groupBy(*key).agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x"))).alias("_rms"))
    gain = F.when(F.col("_rms") / 32768 < 0.001, 1.0).otherwise(F.lit(target) * 32768 / F.col("_rms"))
    return rows.join(whole, key).select("stream", "i", truncate(clamp16(F.col("x") * gain)).cast("int").alias("x"))


def resample_linear(samples: DataFrame, up: int, down: int) -> DataFrame:
    """floor(n * up / down) outputs by linear interpolation; the tail holds the last sample.

    Each pair of neighbours makes the outputs that fall between them, so that nothing is joined.
    """
    order = W.partitionBy("stream").orderBy("i")
    n = F.count("*").over(W.partitionBy("stream"))
    rows = samples.select("stream", "i", "x", F.lead("x").over(order).alias("_y"), F.floor(n * up / down).alias("_n"))
    first = F.expr(f"cast(ceil(i * {up} / {down}) as bigint)")
    last = F.when(F.col("_y").isNull(), F.col("_n") - 1).otherwise(F.least(F.expr(f"cast(ceil((i + 1) * {up} / {down}) as bigint) - 1"), F.col("_n") - 1))
    made = rows.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    part = F.col("k") * down / up - F.col("i")
    y = F.when(F.col("_y").isNull(), F.col("x").cast("double")).otherwise(F.col("x") + (F.col("_y") - F.col("x")) * part)
    return made.select("stream", F.col("k").alias("i"), y.alias("x"))


def rms_meter(samples: DataFrame, window: int) -> DataFrame:
    over = trailing(["stream"], "i", window)
    return samples.select("stream", "i", F.sqrt(F.sum(F.col("x").cast("long") * F.col("x")).over(over) / F.count("*").over(over)).alias("rms"))


def phase_correlation(pairs: DataFrame, window: int) -> DataFrame:
    """Uncentred correlation of ``l`` and ``r`` over a sliding window, within one; fewer than two samples give 0."""
    over = trailing(["stream"], "i", window)
    dot = lambda a, b: F.sum(F.col(a).cast("long") * F.col(b)).over(over)
    power = dot("l", "l").cast("double") * dot("r", "r")
    value = F.when((F.count("*").over(over) < 2) | (power == 0), 0.0).otherwise(dot("l", "r") / F.sqrt(F.when(power > 0, power)))
    return pairs.select("stream", "i", F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)).alias("correlation"))


def clipping(samples: DataFrame, most: int) -> DataFrame:
    return samples.groupBy("stream").agg(F.sum((F.abs("x") >= most).cast("long")).alias("clipped"), F.count("*").alias("n"))


#: Weights of the channels of surround sound (left, right, centre, low frequency, left and right surround).
SURROUND = (1.0, 1.0, 1.0, 0.0, 1.41, 1.41)


def weighted_power(samples: DataFrame, rate: int = 48_000) -> DataFrame:
    """``stream, i, power`` of K-weighted samples (``stream, channel, i, x``; without ``channel``: of one channel).

    Each channel is filtered on its own.  With five channels or more those of the rear weigh more and that of low
    frequencies nothing; otherwise all weigh alike.
    """
    if "channel" not in samples.columns:
        return k_weighted(samples, rate).select("stream", "i", (F.col("y") * F.col("y")).alias("power"))
    own = k_weighted(samples, rate, ("stream", "channel"))
    several = samples.groupBy("stream").agg((F.max("channel") >= 4).alias("_s"))
    weight = F.coalesce(F.get(F.array(*map(F.lit, SURROUND)), F.col("channel").cast("int")), F.lit(0.0))
    rows = own.join(several, "stream").withColumn("_p", F.col("y") * F.col("y") * F.when(F.col("_s"), weight).otherwise(1.0))
    return rows.groupBy("stream", "i").agg(F.sum("_p").alias("power"))


def loudness_blocks(power: DataFrame, size: int, hop: int, most: int = 600) -> DataFrame:
    """Loudness of the last ``most`` of the overlapping whole blocks of ``size`` samples, ``hop`` apart (a divisor of it).

    Samples are summed by hop first, so that a block is a window over a few sums.
    """
    if size % hop:
        raise ValueError("the hop must divide the size")
    hops = power.groupBy("stream", F.expr(f"i div {hop}").alias("block")).agg(F.sum("power").alias("_p"), F.count("*").alias("_c"))
    ahead = W.partitionBy("stream").orderBy("block").rowsBetween(0, size // hop - 1)
    rows = hops.select("stream", "block", (F.sum("_p").over(ahead) / size).alias("_mean"), F.sum("_c").over(ahead).alias("_n")).filter(F.col("_n") == size)
    rows = rows.withColumn("_last", F.max("block").over(W.partitionBy("stream"))).filter(F.col("block") > F.col("_last") - most)
    return rows.select("stream", "block", F.when(F.col("_mean") > 0, -0.691 + 10 * F.log10(F.when(F.col("_mean") > 0, F.col("_mean")))).otherwise(F.lit(float("-inf"))).alias("lufs"))


def integrated_loudness(blocks: DataFrame, floor: float = -70.0, relative: float = -10.0) -> DataFrame:
    """Two gates; the result is the mean of the LUFS values that pass both."""
    loud = blocks.filter(F.col("lufs") > floor).withColumn("_mean", F.avg("lufs").over(W.partitionBy("stream")))
    return loud.filter(F.col("lufs") > F.col("_mean") + relative).groupBy("stream").agg(F.avg("lufs").alias("lufs"), F.count("*").alias("blocks"))


def loudness_range(blocks: DataFrame, floor: float = -70.0) -> DataFrame:
    """The 95th less the 10th percentile by index of the sorted blocks above the floor; one block gives 0."""
    order = W.partitionBy("stream").orderBy("lufs", "block")
    ranked = blocks.filter(F.col("lufs") > floor).select("stream", "lufs", (F.row_number().over(order) - 1).alias("_r"), F.count("*").over(W.partitionBy("stream")).alias("_n"))
    at = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * F.lit(q) / 100), F.col("lufs")))
    return ranked.groupBy("stream").agg(F.when(F.max("_n") < 2, 0.0).otherwise(at(95) - at(10)).alias("lra"))


def true_peak(samples: DataFrame) -> DataFrame:
    """Linear interpolation adds no peaks, so that this is the largest magnitude."""
    return samples.groupBy("stream").agg(F.max(F.abs("x")).alias("peak"))


def normalizing_gain(loudness: DataFrame, peaks: DataFrame, target: float = -23.0, ceiling: float = -1.0) -> DataFrame:
    """``stream, gain_db``: what takes a stream (``lufs``) to the target, or its peak to the ceiling if that is less."""
    room = ceiling - 20 * F.log10(F.col("peak") / 32768.0)
    return loudness.join(peaks, "stream").select("stream", F.least(target - F.col("lufs"), room).alias("gain_db"))
