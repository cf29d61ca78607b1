"""Event time: sessions, late rows, repeated rows, and joins of two streams, in forms that run in batch and on streams.

``packets`` are ``stream, seq, ts, size``; ``ts`` is the time of the event.  On a stream the state that is kept is bounded by the
watermarks; in batch they do nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(packets: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a stream's packets with less than a gap between two of them: ``stream, start, stop, packets, size``.

    A session stops a gap after its last packet.  On a stream it is given once the watermark has passed that; later rows
    are dropped.
    """
    rows = packets.withWatermark("ts", late).groupBy("stream", F.session_window("ts", gap).alias("_w")).agg(F.count("*").alias("packets"), F.sum("size").alias("size"))
    return rows.select("stream", F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "packets", "size")


def unique(packets: DataFrame, key: list[str], within: str = "10 minutes") -> DataFrame:
    """Packets without repetitions of a key that arrive within so much of event time."""
    rows = packets.withWatermark("ts", within)
    return rows.dropDuplicatesWithinWatermark(key) if packets.isStreaming else rows.dropDuplicates(key)


def cues_of_frames(frames: DataFrame, cues: DataFrame, longest: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """``track, frame_no, ordinal``: the cues that stand when a frame is shown, for two streams or two tables.

    ``frames``: ``track, frame_no, ts``; ``cues``: ``track, ordinal, start, stop`` (the stop not included), none longer
    than ``longest``, which bounds how long a frame waits for a cue and a cue for frames.
    """
    shown = frames.select(F.col("track").alias("_t"), "frame_no", "ts").withWatermark("ts", late)
    held = cues.select("track", "ordinal", "start", "stop").withWatermark("start", late)
    span = F.expr(f"INTERVAL {longest}")
    near: Column = (F.col("_t") == F.col("track")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + span)
    return shown.join(held, near & (F.col("ts") < F.col("stop"))).select("track", "frame_no", "ordinal")


def sliding(packets: DataFrame, window: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes of each stream in overlapping windows: ``stream, start, stop, packets, size``."""
    rows = packets.withWatermark("ts", late).groupBy("stream", F.window("ts", window, step).alias("_w")).agg(F.count("*").alias("packets"), F.sum("size").alias("size"))
    return rows.select("stream", F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "packets", "size")
