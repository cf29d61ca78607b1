"""Packets, encoder statistics, cues and the transcode queue: selection, joins, greedy folds and text writers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clock
from .folds import ordered_fold


class _Segmenter:
    """The open segment of a stream; it is given out when the next one starts or the stream ends."""

    def __init__(self, key: tuple, target: int, most: int):
        self.stream, self.target, self.most = key[0], target, most
        self.number, self.open = -1, None

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        done = []
        for pts, size, keyframe in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("pts", "size", "keyframe")), strict=True):
            elapsed = max(pts - self.open[0], 0) if self.open else 0
            if self.open is None or (keyframe and elapsed >= self.target) or elapsed >= self.most:
                done += self._closed()
                self.number, self.open = self.number + 1, [pts, pts, size, 1]
            else:
                self.open[1:] = [pts, self.open[2] + size, self.open[3] + 1]
        return self._rows(done)

    def _closed(self) -> list[tuple]:
        return [(self.stream, self.number, self.open[0], self.open[1] - self.open[0], self.open[2], self.open[3])] if self.open else []

    def _rows(self, done: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], [c.split()[0] for c in SEGMENT.split(", ")])

    def finish(self) -> pa.RecordBatch:
        return self._rows(self._closed())


SEGMENT = "stream long, segment int, start long, duration long, size long, packets long"


def segments(packets: DataFrame, target: int, most: int) -> DataFrame:
    """Split each stream at a keyframe once ``target`` ms have passed, or at ``most`` ms.

    A segment's duration runs to its last packet's time; the splits depend on earlier ones, so that they are a fold
    over the ordered packets of a stream, which holds the open segment alone.
    """
    rows = packets.select(F.col("stream").cast("long").alias("stream"), "seq", "pts", "size", "keyframe")
    return ordered_fold(rows, ["stream"], ["seq"], lambda key: _Segmenter(key, target, most), SEGMENT)


class _Numbering(_Segmenter):
    """Gives out the packets themselves, with the number of their segment."""

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        numbers = []
        for pts, keyframe in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("pts", "keyframe")), strict=True):
            elapsed = max(pts - self.open[0], 0) if self.open else 0
            if self.open is None or (keyframe and elapsed >= self.target) or elapsed >= self.most:
                self.number, self.open = self.number + 1, [pts]
            numbers.append(self.number)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers, pa.int32())], [*rows.schema.names, "segment"])

    def finish(self) -> None:
        return None


def segment_numbers(packets: DataFrame, target: int, most: int) -> DataFrame:
    """``stream, seq, pts, size, keyframe, segment``: each packet with the number of the segment that the fold puts it in."""
    rows = packets.select(F.col("stream").cast("long").alias("stream"), F.col("seq").cast("long").alias("seq"), F.col("pts").cast("long").alias("pts"), F.col("size").cast("long").alias("size"), "keyframe")
    return ordered_fold(rows, ["stream"], ["seq"], lambda key: _Numbering(key, target, most), "stream long, seq long, pts long, size long, keyframe boolean, segment int")


def segments_of(placed: DataFrame) -> DataFrame:
    """The segments of packets that carry their numbers: the rows of ``segments``."""
    first, last = F.min_by("pts", "seq"), F.max_by("pts", "seq")
    return placed.groupBy("stream", "segment").agg(first.alias("start"), (last - first).alias("duration"), F.sum("size").alias("size"), F.count("*").alias("packets"))


def segment_name(index: Column) -> Column:
    return F.format_string("segment_%05d.ts", index)


def media_playlist(segments: DataFrame, target_seconds: int, vod: bool = True) -> DataFrame:
    """An HLS media playlist for each stream; the media sequence is the number of segments."""
    line = F.concat(F.format_string("#EXTINF:%.3f,", F.col("duration") / 1000.0), F.lit("\n"), segment_name(F.col("segment")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("segment", line.alias("line")))), lambda x: x["line"])
    made = segments.groupBy("stream").agg(F.count("*").alias("n"), lines.alias("lines"))
    head = F.format_string(f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:{target_seconds}\n#EXT-X-MEDIA-SEQUENCE:%d\n", F.col("n"))
    return made.select("stream", F.concat(head, F.array_join("lines", "\n"), F.lit("\n#EXT-X-ENDLIST\n" if vod else "\n")).alias("playlist"))


def playlist_text(segments: list[tuple[int, int]], target_seconds: int, vod: bool = True) -> str:
    """The same playlist of a stream's segments (number and duration, in order) that are at hand, as a sink has them."""
    lines = [f"#EXTINF:{duration / 1000:.3f},\nsegment_{number:05d}.ts" for number, duration in segments]
    head = f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:{target_seconds}\n#EXT-X-MEDIA-SEQUENCE:{len(lines)}\n"
    return head + "\n".join(lines) + ("\n#EXT-X-ENDLIST\n" if vod else "\n")


def master_playlist(profiles: DataFrame) -> DataFrame:
    """One stream line per profile (``ordinal, name, width, height, bits``) in order."""
    line = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d,RESOLUTION=%dx%d\n%s.m3u8", "bits", "width", "height", "name")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return profiles.agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("playlist"))


def srt_track(cues: DataFrame) -> DataFrame:
    """SubRip text of each track, cues numbered from one."""
    order = W.partitionBy("track").orderBy("ordinal")
    block = F.concat_ws("\n", F.row_number().over(order).cast("string"), F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms"))), F.col("text"))
    return _joined(cues.select("track", "ordinal", block.alias("b")), "\n\n", "", "\n")


def vtt_track(cues: DataFrame) -> DataFrame:
    """WebVTT text of each track; hours of zero are left out."""
    times = F.concat(clock(F.col("start_ms"), ".", short=True), F.lit(" --> "), clock(F.col("end_ms"), ".", short=True))
    return _joined(cues.select("track", "ordinal", F.concat_ws("\n", times, "text").alias("b")), "\n\n", "WEBVTT\n\n", "\n")


def _joined(blocks: DataFrame, between: str, head: str, tail: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "b"))), lambda x: x["b"])
    return blocks.groupBy("track").agg(F.concat(F.lit(head), F.array_join(ordered, between), F.lit(tail)).alias("body"))


def edl(events: DataFrame, title: str, fps: int = 25) -> DataFrame:
    """A CMX3600 list of each timeline (``track, ordinal, reel, start_ms, end_ms``), events numbered from one."""
    from ..functions.scalars import smpte_from_frames

    code = lambda ms: smpte_from_frames(F.floor(ms * fps / 1000), fps)
    order = W.partitionBy("track").orderBy("ordinal")
    times = F.concat_ws(" ", code(F.col("start_ms")), code(F.col("end_ms")), code(F.col("start_ms")), code(F.col("end_ms")))
    line = F.concat(F.format_string("%03d  %-8s V     C        ", F.row_number().over(order), "reel"), times)
    return _joined(events.select("track", "ordinal", line.alias("b")), "\n", f"TITLE: {title}\nFCM: NON-DROP FRAME\n\n", "\n")


def group_statistics(plan: DataFrame, most: int) -> DataFrame:
    """``stream, frames, groups, open, mean``: of planned frames, in whole groups of the largest size; ``open`` counts the
    frames since the last keyframe."""
    keyframe = F.max(F.when(F.col("planned").isin("I", "IDR"), F.col("idx")))
    rows = plan.groupBy("stream").agg(F.count("*").alias("frames"), (F.max("idx") - keyframe + 1).alias("open"))
    groups = F.expr(f"frames div {most}")
    return rows.select("stream", "frames", groups.alias("groups"), "open", F.expr(f"frames div greatest(frames div {most}, 1)").alias("mean"))


class _FramePlan:
    """Frames since the last keyframe; the pattern between keyframes counts from it."""

    def __init__(self, key: tuple, interval: int, least: int, most: int, between: int, idr: bool):
        self.stream, self.interval, self.least, self.most, self.between = key[0], interval, least, most, between
        self.first, self.since = "IDR" if idr else "I", -1

    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        kinds = []
        for scene in rows.column(rows.schema.get_field_index("scene")).to_pylist():
            if self.since < 0:
                kind = self.first
            elif (0 < self.interval <= self.since) or (scene and self.since >= self.least) or self.since >= self.most:
                kind = "I"
            else:
                kind = "P" if not self.between or self.since % (self.between + 1) == 0 else "B"
            self.since = 1 if kind in ("I", "IDR") else self.since + 1
            kinds.append(kind)
        idx = rows.column(rows.schema.get_field_index("idx"))
        return pa.RecordBatch.from_arrays([pa.array([self.stream] * len(kinds), pa.int64()), idx, pa.array(kinds, pa.string())], ["stream", "idx", "planned"])

    def finish(self) -> None:
        return None


def group_frame_types(frames: DataFrame, most: int, interval: int = 0, least: int = 1, between: int = 2, idr: bool = False) -> DataFrame:
    """``stream, idx, planned``: I, P or B for each frame (``stream, idx, scene``: whether it starts a new scene).

    The first frame, the ``interval``-th since the last keyframe (0: none is forced), a new scene from the ``least``-th
    on, and the ``most``-th are I; from one on, every (``between`` + 1)-th frame is P and those between are B.
    """
    rows = frames.select(F.col("stream").cast("long").alias("stream"), F.col("idx").cast("long").alias("idx"), F.coalesce("scene", F.lit(False)).alias("scene"))
    return ordered_fold(rows, ["stream"], ["idx"], lambda key: _FramePlan(key, interval, least, most, between, idr), "stream long, idx long, planned string")


def transfer_speed(jobs: DataFrame, key: str) -> DataFrame:
    """Bytes put out per second of encoding (``bytes``, ``ms``) for each key; 0 where no time was taken."""
    seconds = F.sum("ms") / 1000.0
    return jobs.groupBy(key).agg(F.when(seconds > 0, F.sum("bytes") / F.nullif(seconds, F.lit(0.0))).otherwise(0.0).alias("speed"))


def look_ahead_bitrate(stats: DataFrame, ahead: int, base: int, order: Sequence[str] = ("idx",)) -> DataFrame:
    """Bits of each frame by its own complexity and that of the frames ahead, within half and three times the base.

    Where the rows already lie in the order of the columns of ``order``, they are not sorted again.
    """
    window = W.partitionBy("stream").orderBy(*order).rowsBetween(0, ahead - 1)
    mean = F.avg("complexity").over(W.partitionBy("stream"))
    factor = F.when(F.col("kind") == "I", 1.5).when(F.col("kind") == "P", 1.0).otherwise(0.7)
    share = F.when(mean == 0, 1.0).otherwise((0.7 * F.col("complexity") + 0.3 * F.avg("complexity").over(window)) / F.when(mean > 0, mean))
    return stats.withColumn("budget", F.least(F.greatest(base * share * factor, F.lit(base * 0.5)), F.lit(base * 3.0)))


def quantizer(stats: DataFrame, base: float) -> DataFrame:
    mean = F.avg("complexity").over(W.partitionBy("stream"))
    factor = F.when(F.col("kind") == "I", 0.8).when(F.col("kind") == "P", 1.0).otherwise(1.2)
    return stats.withColumn("q", F.least(F.greatest(base * mean / F.greatest(F.col("complexity").cast("double"), F.lit(0.1)) * factor, F.lit(0.0)), F.lit(51.0)))


def pass_statistics(stats: DataFrame) -> DataFrame:
    """Totals, means and a ten-bin histogram of complexity (0..1) of each stream."""
    bins = [F.sum((F.floor(F.col("complexity") / 10.0 * 9.99) == b).cast("long")).alias(f"bin{b}") for b in range(10)]
    return stats.groupBy("stream").agg(F.count("*").alias("frames"), F.sum("bits").alias("bits"), F.avg("complexity").alias("mean"), F.max("complexity").alias("peak"), *bins)


def stage_profile(times: DataFrame, key: str, value: str) -> DataFrame:
    mean = F.avg(value)
    return times.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), mean.alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(value).alias("spread"), (1000 / mean).alias("rate"))


def assign_jobs(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """``worker_id, job_id``: what a round of requests gives out, one job at most to a worker and a job to one worker.

    Ready workers with room ask in the order of their ids; each takes the queued job of the highest priority, then the
    oldest, that is left and that it can handle: a job's ``codec`` and ``hw`` may be null (no requirement), a worker has
    arrays of ``codecs`` and ``hws``.

    Of the jobs with equal requirements only as many as there are workers can be taken, so that what meets in one task
    is that many for each requirement: it grows with the fleet, not with the queue.
    """
    able = workers.filter("state = 'ready' AND running < most").select(F.col("worker_id").cast("long").alias("worker_id"), "codecs", "hws")
    fleet = able.agg(F.count("*").alias("_w"))
    place = F.row_number().over(W.partitionBy("codec", "hw").orderBy(F.col("priority").desc(), "created", "job_id"))
    queued = jobs.filter("state = 'queued'").select(F.col("job_id").cast("long").alias("job_id"), "priority", "created", "codec", "hw", place.alias("_r"))
    wanted = queued.crossJoin(F.broadcast(fleet)).filter("_r <= _w").drop("_r", "_w")  # the fleet is one row

    def match(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queues: dict[tuple, list[tuple]] = {}
        for j in left.astype(object).where(left.notna(), None).sort_values(["priority", "created", "job_id"], ascending=[False, True, True]).itertuples():
            queues.setdefault((j.codec, j.hw), []).append((-j.priority, j.created, j.job_id))
        at, given = dict.fromkeys(queues, 0), []
        for w in right.sort_values("worker_id").itertuples():
            codecs, hws = set(w.codecs) | {None}, set(w.hws) | {None}
            heads = [(queues[k][at[k]], k) for k in queues if k[0] in codecs and k[1] in hws and at[k] < len(queues[k])]
            if heads:
                job, k = min(heads, key=lambda h: h[0])
                at[k] += 1
                given.append((w.worker_id, job[2]))
        return pd.DataFrame(given, columns=["worker_id", "job_id"])

    one = F.lit(0).alias("_g")
    return wanted.select("*", one).groupBy("_g").cogroup(able.select("*", one).groupBy("_g")).applyInPandas(match, "worker_id long, job_id long")


def bd_rate(points: DataFrame, metric: str = "rate") -> DataFrame:
    """Bjontegaard delta of two rate-distortion curves of each key (``key, curve, rate, psnr``; curves 'a' and 'b').

    Cubic fits of log rate over PSNR, integrated at a hundred midpoints of the common range.  Fewer than four points
    compare mean rates.  ``metric='psnr'`` swaps the axes.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["curve"] == c] for c in "ab")
        rate = metric == "rate"
        if len(a) < 4 or len(b) < 4:
            value = (b["rate"].mean() / a["rate"].mean() - 1) * 100 if rate else b["psnr"].mean() - a["psnr"].mean()
        else:
            x = [(c["psnr"] if rate else np.log(c["rate"])).to_numpy() for c in (a, b)]
            y = [(np.log(c["rate"]) if rate else c["psnr"]).to_numpy() for c in (a, b)]
            low, high = max(v.min() for v in x), min(v.max() for v in x)
            at = low + (np.arange(100) + 0.5) * (high - low) / 100
            diff = float(np.mean(np.polyval(np.polyfit(x[1], y[1], 3), at) - np.polyval(np.polyfit(x[0], y[0], 3), at)))
            value = (np.exp(diff) - 1) * 100 if rate else diff
        return pd.DataFrame({"key": [int(pdf["key"].iloc[0])], "delta": [float(value)]})

    return points.groupBy("key").applyInPandas(run, "key long, delta double")


def drift_correction(offsets: DataFrame, step: float) -> DataFrame:
    """Whole samples to add or drop at each row (``stream, i, drift`` per row), from the running sum of drifts.

    The accumulated drift in units of ``step`` is truncated; its changes are the corrections.
    """
    order = W.partitionBy("stream").orderBy("i")
    units = F.sum("drift").over(order.rowsBetween(W.unboundedPreceding, 0)) / step
    whole = offsets.withColumn("_w", F.when(units < 0, F.ceil(units)).otherwise(F.floor(units)).cast("long"))
    return whole.select("stream", "i", (F.col("_w") - F.coalesce(F.lag("_w").over(order), F.lit(0))).alias("correction"))


def part_durations(parts: DataFrame) -> DataFrame:
    """``stream, segment, duration``: a segment lasts as long as its parts together."""
    return parts.groupBy("stream", "segment").agg(F.sum("duration").alias("duration"))


def _seconds(ms: Column | int, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", (F.lit(ms) if isinstance(ms, int) else ms) / F.lit(1000.0))


def low_latency_playlist(parts: DataFrame, target_ms: int, part_ms: int, live: bool = True, reports: DataFrame | None = None, hold_back_ms: int | None = None, skip_ms: int | None = None) -> DataFrame:
    """A low-latency playlist of each stream from the parts (``segment, part, duration, independent``) of its segments.

    Each segment's parts come before its own entry.  A live playlist tells how it may be reloaded and hints at the part
    that comes next; any other one ends.  ``reports`` (``stream, uri, last_segment, last_part``: the last may be null) tell
    how far other renditions are.
    """
    flag = F.when(F.col("independent"), ",INDEPENDENT=YES").otherwise("")
    line = F.concat(F.lit("#EXT-X-PART:DURATION="), _seconds(F.col("duration"), 5), F.format_string(',URI="segment_%05d.%d.m4s"', "segment", "part"), flag)
    by_part = F.transform(F.array_sort(F.collect_list(F.struct("part", line.alias("line")))), lambda x: x["line"])
    whole = parts.groupBy("stream", "segment").agg(F.array_join(by_part, "\n").alias("_p"), F.sum("duration").alias("_d"), F.max("part").alias("_l"))
    entry = F.concat("_p", F.lit("\n#EXTINF:"), _seconds(F.col("_d")), F.format_string(",\nsegment_%05d.m4s\n", "segment"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("segment", entry.alias("e")))), lambda x: x["e"])
    made = whole.groupBy("stream").agg(F.array_join(entries, "").alias("_body"), F.count("*").alias("_n"), F.max(F.struct("segment", "_l")).alias("_last"))
    told = F.lit("")
    if reports is not None:
        about = F.concat(F.format_string('#EXT-X-RENDITION-REPORT:URI="%s",LAST-MSN=%d', "uri", "last_segment"), F.coalesce(F.format_string(",LAST-PART=%d", F.col("last_part")), F.lit("")), F.lit("\n"))
        about = F.when(F.col("last_part").isNull(), F.format_string('#EXT-X-RENDITION-REPORT:URI="%s",LAST-MSN=%d\n', "uri", "last_segment")).otherwise(about)
        listed = reports.groupBy("stream").agg(F.array_join(F.array_sort(F.collect_list(about)), "").alias("_told"))
        made, told = made.join(listed, "stream", "left"), F.coalesce("_told", F.lit(""))
    control = [F.lit("#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES")]
    control += [F.concat(F.lit(f",{name}="), _seconds(ms)) for name, ms in (("HOLD-BACK", hold_back_ms), ("PART-HOLD-BACK", 3 * part_ms), ("CAN-SKIP-UNTIL", skip_ms)) if ms is not None]
    head = [F.lit(f"#EXTM3U\n#EXT-X-VERSION:9\n#EXT-X-TARGETDURATION:{target_ms // 1000}\n"), *([*control, F.lit("\n")] if live else [])]
    head += [F.lit("#EXT-X-PART-INF:PART-TARGET="), _seconds(part_ms), F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), F.col("_n").cast("string"), F.lit("\n" if live else "\n#EXT-X-PLAYLIST-TYPE:VOD\n")]
    hint = F.format_string('#EXT-X-PRELOAD-HINT:TYPE=PART,URI="segment_%05d.%d.m4s"\n', F.col("_last.segment"), F.col("_last._l") + 1)
    return made.select("stream", F.concat(*head, "_body", *([hint] if live else []), told, F.lit("" if live else "#EXT-X-ENDLIST\n")).alias("playlist"))


def low_latency_master(profiles: DataFrame) -> DataFrame:
    """The master playlist of profiles (``ordinal, name, width, height, bits, fps``); the average rate is nine tenths."""
    line = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d,AVERAGE-BANDWIDTH=%d,RESOLUTION=%dx%d,FRAME-RATE=%s\n%s.m3u8\n", F.col("bits"), F.floor(F.col("bits") * 0.9), F.col("width"), F.col("height"), F.col("fps").cast("string"), F.col("name"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return profiles.agg(F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:9\n#EXT-X-INDEPENDENT-SEGMENTS\n\n"), F.array_join(lines, "")).alias("playlist"))


def average_psnr(points: DataFrame) -> DataFrame:
    """The mean of each curve's points (``key, curve, psnr``)."""
    return points.groupBy("key", "curve").agg(F.avg("psnr").alias("psnr"))


def worker_checks(workers: DataFrame, codec: Column, hw: Column, timeout: int) -> DataFrame:
    """``worker_id, accepts, healthy, handles``: room for a job, a late enough beat (whole seconds), and the capabilities
    for a codec and hardware (null: no requirement)."""
    has = lambda names, one: F.coalesce(F.array_contains(names, one), F.lit(True))
    return workers.select("worker_id", ((F.col("state") == "ready") & (F.col("running") < F.col("most"))).alias("accepts"), (F.col("beat_age") < timeout).alias("healthy"), (has("codecs", codec) & has("hws", hw)).alias("handles"))


def check_chapters(chapters: DataFrame) -> DataFrame:
    """``track, ordinal, start_ms, end_ms, overlaps``: a missing end is the next one's start (the last stays open); an end
    after the next start is an error, which is told."""
    after = F.lead("start_ms").over(W.partitionBy("track").orderBy("start_ms", "ordinal"))
    rows = chapters.withColumn("_next", after)
    return rows.select("track", "ordinal", "start_ms", F.coalesce("end_ms", "_next").alias("end_ms"), F.coalesce(F.col("end_ms") > F.col("_next"), F.lit(False)).alias("overlaps"))
