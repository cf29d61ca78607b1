"""Catalogs of codecs and formats, proxies, metrics documents, and checks of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FORMATS

#: Codecs that are listed, with their names and kinds of media.
CODECS = [
    ("h264", "H.264 / AVC / MPEG-4 AVC / MPEG-4 part 10", "video"),
    ("hevc", "H.265 / HEVC / High Efficiency Video Coding", "video"),
    ("vp8", "On2 VP8", "video"),
    ("vp9", "Google VP9", "video"),
    ("aac", "Advanced Audio Coding", "audio"),
    ("mp3", "MPEG Audio Layer 3", "audio"),
    ("opus", "Opus Interactive Audio Codec", "audio"),
]
#: Long names, MIME types and capabilities (seekable, several streams, time stamps, metadata) of formats.
DETAILS = [
    ("mp4", "MPEG-4 Part 14", ["video/mp4"], (True, True, True, True)),
    ("matroska", "Matroska", ["video/x-matroska"], (True, True, True, True)),
    ("wav", "WAV / WAVE (Waveform Audio)", ["audio/wav", "audio/wave"], (True, False, True, True)),
    ("flac", "FLAC (Free Lossless Audio Codec)", ["audio/flac"], (True, False, True, True)),
    ("ogg", "OGG container", ["audio/ogg"], (True, True, True, True)),
    ("mp3", "MP3 (MPEG Audio Layer 3)", ["audio/mpeg"], (True, False, True, True)),
    ("y4m", "YUV4MPEG2 raw video", ["video/x-yuv4mpeg"], (True, False, True, False)),
    ("webm", "WebM", ["video/webm", "audio/webm"], (True, True, True, True)),
    ("avi", "AVI (Audio Video Interleave)", ["video/x-msvideo"], (True, True, True, True)),
    ("flv", "FLV (Flash Video)", ["video/x-flv"], (True, True, True, True)),
    ("mpegts", "MPEG-TS (MPEG Transport Stream)", ["video/mp2t"], (False, True, True, False)),
]


def codecs(spark: SparkSession, media: str | None = None) -> DataFrame:
    """The listed codecs of a kind of media; any other filter than video and audio lists all."""
    rows = spark.createDataFrame(CODECS, "id string, name string, media string")
    return rows.filter(F.col("media") == media) if media in ("video", "audio") else rows


def formats(spark: SparkSession) -> DataFrame:
    """``name, long_name, extensions, mime_types, seekable, multi_stream, timestamps, metadata`` of each known format."""
    rows = [(n, long, FORMATS[n], mime, *flags) for n, long, mime, flags in DETAILS]
    return spark.createDataFrame(rows, "name string, long_name string, extensions array<string>, mime_types array<string>, seekable boolean, multi_stream boolean, timestamps boolean, metadata boolean")


def with_format(files: DataFrame, spark: SparkSession, path: str = "path") -> DataFrame:
    """Files with the details of the format that their extensions name (null if unknown): a join with a bounded list."""
    known = formats(spark).withColumn("_ext", F.explode("extensions"))
    return files.withColumn("_ext", F.lower(F.element_at(F.split(path, r"\."), -1))).join(F.broadcast(known), "_ext", "left").drop("_ext")


def light_level_error(max_cll: Column, max_fall: Column) -> Column:
    """What is wrong with content light levels in nits; null if they are in range."""
    return F.when((max_cll < 1) | (max_cll > 10000), "MaxCLL").when((max_fall < 1) | (max_fall > max_cll), "MaxFALL")


#: What a proxy's sides are divided by.
RESOLUTIONS = {"full": 1, "half": 2, "quarter": 4, "eighth": 8}
#: Bits per pixel at thirty frames a second, or bits per second up to a height.
PER_PIXEL = {"h264": 0.1, "h265": 0.05, "mjpeg": 0.3}
PER_HEIGHT = {"prores": ((540, 10_000_000), (720, 18_000_000), (1080, 36_000_000), (None, 45_000_000)), "dnxhr": ((540, 4_000_000), (720, 6_000_000), (1080, 8_000_000), (None, 12_000_000))}


def proxy_size(width: Column, height: Column, resolution: str) -> Column:
    by = RESOLUTIONS[resolution]
    return F.struct(F.floor(width / by).cast("int").alias("width"), F.floor(height / by).cast("int").alias("height"))


def proxy_bitrate(width: Column, height: Column, codec: str) -> Column:
    """Recommended bits per second of a proxy."""
    if codec in PER_PIXEL:
        return F.floor(F.round(width * height * PER_PIXEL[codec] * 30, 3)).cast("long")
    out = F.lit(PER_HEIGHT[codec][-1][1])
    for most, bits in reversed(PER_HEIGHT[codec][:-1]):
        out = F.when(height <= most, bits).otherwise(out)
    return out.cast("long")


def proxy_sidecar(files: DataFrame) -> DataFrame:
    """``path, document``: JSON that tells of a proxy's original (``path, width, height, proxy_width, proxy_height, scale, codec, offset``)."""
    sides = lambda w, h: F.array(F.col(w), F.col(h))
    body = F.struct(
        F.col("path").alias("original_path"), sides("width", "height").alias("original_resolution"), sides("proxy_width", "proxy_height").alias("proxy_resolution"),
        F.col("scale").alias("scale_factor"), "codec", F.col("offset").alias("timecode_offset"),
    )
    return files.select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def probe_streams(packets: DataFrame, key: list[str]) -> DataFrame:
    """The key, ``packets, keyframes, size, duration`` (from the first time to the end of the last packet) of each stream."""
    end = F.col("pts") + (F.coalesce("duration", F.lit(0)) if "duration" in packets.columns else F.lit(0))
    return packets.groupBy(*key).agg(F.count("*").alias("packets"), F.sum(F.col("keyframe").cast("long")).alias("keyframes"), F.sum("size").cast("long").alias("size"), (F.max(end) - F.min("pts")).alias("duration"))


def probe(packets: DataFrame) -> DataFrame:
    """``file, document``: JSON that tells of each file (packets with times in ms): its format, duration, size, rate and streams.

    A file lasts as long as its longest stream; its rate is null if none has a length.
    """
    from ..functions.scalars import format_of

    streams = probe_streams(packets, ["file", "stream_index"])
    one = F.struct(F.col("stream_index").alias("index"), "packets", "keyframes", "size", "duration")
    files = streams.groupBy("file").agg(F.max(F.when(F.col("duration") > 0, F.col("duration"))).alias("duration"), F.sum("size").alias("size"), F.array_sort(F.collect_list(one)).alias("streams"))
    rate = F.expr("size * 8000 div duration").alias("bit_rate")
    body = F.struct(F.col("file").alias("filename"), F.struct(format_of(F.col("file")).alias("name"), "duration", "size", rate).alias("format"), "streams")
    return files.select("file", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def bits_per_element(values: Column, scale: float = 1.0) -> Column:
    """An aggregate: the bits that normally distributed values take, half a bit for narrow ones."""
    spread = F.sqrt(F.var_pop(values) / (scale * scale))
    return F.when(spread > 0.1, F.log2(F.when(spread > 0.1, spread)) + 1 + 0.5 * F.log2(2 * F.pi() * F.e())).otherwise(0.5)


def job_metrics(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """One row of counters and gauges of a queue (``state, bytes, ms``) and its workers."""
    count = lambda *s: F.sum(F.col("state").isin(*s).cast("long"))
    done = F.col("state") == "complete"
    rows = jobs.agg(
        F.count("*").alias("jobs_total"), count("running").alias("jobs_running"), count("complete").alias("jobs_completed"), count("failed").alias("jobs_failed"),
        count("cancelled").alias("jobs_cancelled"), F.sum(F.when(done, F.col("bytes")).otherwise(0)).alias("bytes_processed"),
        (F.sum(F.when(done, F.col("ms")).otherwise(0)) / 1000.0).alias("encoding_time_seconds"), count("queued").alias("queue_depth"),
    )
    return rows.crossJoin(F.broadcast(workers.agg(F.count("*").alias("worker_count"))))  # two single rows


METRICS = {
    "jobs_total": ("counter", "jobs submitted"), "jobs_running": ("gauge", "jobs that run"), "jobs_completed": ("counter", "jobs completed"), "jobs_failed": ("counter", "jobs failed"),
    "jobs_cancelled": ("counter", "jobs cancelled"), "worker_count": ("gauge", "registered workers"), "bytes_processed": ("counter", "bytes put out"),
    "encoding_time_seconds": ("counter", "seconds of encoding"), "queue_depth": ("gauge", "jobs that wait"),
}


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*METRICS)).alias("document"))


def metrics_text(metrics: DataFrame, prefix: str = "media") -> DataFrame:
    """The text exposition of metrics: help, type and value of each."""
    one = lambda n, kind, text: F.concat(F.lit(f"# HELP {prefix}_{n} {text}\n# TYPE {prefix}_{n} {kind}\n{prefix}_{n} "), F.col(n).cast("string"), F.lit("\n"))
    return metrics.select(F.concat_ws("\n", *[one(n, *about) for n, about in METRICS.items()]).alias("body"))


def find_frame(index: DataFrame, frame: int, at: str = "frame_no") -> DataFrame:
    """The first entry of each stream's index for exactly this frame (``stream, frame_no, position, keyframe``)."""
    return index.filter(F.col(at) == frame).groupBy("stream").agg(F.min_by(F.struct("position", "keyframe"), "position").alias("_e")).select("stream", "_e.*")


def keyframes(index: DataFrame) -> DataFrame:
    return index.filter("keyframe")


def lsb_payload(data: Column, n: int) -> Column:
    """The first ``n`` bytes hidden in the lowest bits of consecutive values, the highest bit first."""
    bit = lambda k, b: F.shiftleft(F.get(data, F.lit(8 * k + b)).bitwiseAND(1), 7 - b)
    return F.array(*[sum((bit(k, b) for b in range(1, 8)), bit(k, 0)).cast("int") for k in range(n)])


def merge_tags(tags: Column, more: Column) -> Column:
    """Tags with those of ``more`` set; null maps count as empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(tags, none), F.coalesce(more, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
