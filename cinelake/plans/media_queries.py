"""Queries that write files of the given tables' rows on executors, read them back and give what was read.

A file holds the events of a stretch of ids, so that there are more files, not longer ones, the more events there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import blocks, interpolation, nal, neighbours, pixels
from ..operators import control as C
from ..sources import media, packages, packet_index, sinks
from ..sources.files import scratch
from ..streaming import event_time
from . import views
from .registration import query

#: Events of a file.
STRETCH = 4000

_ROW = f"""rows AS (SELECT f, (seq % 2)::INTEGER AS stream_index, seq, 40 * seq AS pts, event_type || ':' || event_id || ':' || repeat(event_type, (event_id % 40)::INTEGER) AS body, event_type = 'signup' AS key
FROM (SELECT *, event_id // {STRETCH} AS f, row_number() OVER (PARTITION BY event_id // {STRETCH} ORDER BY event_id) - 1 AS seq FROM events))"""
ROWS = f"WITH {_ROW}"
_SHOWN = "stream_index, octet_length(encode(body))::INTEGER AS size, md5(body) AS md5"


def _rows(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """Packets of two streams in each file, their bodies made of the events."""
    f = F.expr(f"event_id div {STRETCH}")
    rows = views.table(spark, sf_dir, "events").select("event_id", "event_type", f.alias("f"))
    rows = rows.withColumn("seq", (F.row_number().over(W.partitionBy("f").orderBy("event_id")) - 1).cast("long"))
    body = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.lit(":"), F.expr("repeat(event_type, cast(event_id % 40 as int))"))
    return rows.select(
        F.format_string(f"%d.{suffix}", "f").alias("file"), (F.col("seq") % 2).cast("int").alias("stream_index"), "seq", (40 * F.col("seq")).alias("pts"), (40 * F.col("seq")).alias("dts"),
        (F.col("event_type") == "signup").alias("keyframe"), body.cast("binary").alias("data"),
    )


def _number() -> Column:
    return F.regexp_extract("file", r"(\d+)\.\w+$", 1).cast("long").alias("f")


def _back(spark: SparkSession, sf_dir: str, suffix: str, rows: DataFrame | None = None, **options: str) -> DataFrame:
    folder = scratch(spark, suffix)
    sinks.write(_rows(spark, sf_dir, suffix) if rows is None else rows, folder, suffix, **options)
    return media.read_media(spark, f"{folder}/*.{suffix}")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(_number(), "stream_index", *more, F.octet_length("data").alias("size"), F.md5("data").alias("md5"))


@query(f"{ROWS} SELECT f, pts, {_SHOWN} FROM rows")
def round_trip_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_back(spark, sf_dir, "ts", kinds="0x1B,0x0F"), "pts")


@query(f"{ROWS} SELECT f, seq, pts, key AS keyframe, {_SHOWN} FROM rows")
def round_trip_webm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_back(spark, sf_dir, "webm", codecs="V_VP9,A_OPUS"), "seq", "pts", "keyframe")


@query(f"{ROWS} SELECT f, seq, 40 * (seq - seq % 2) AS pts, key OR seq % 2 = 1 AS keyframe, {_SHOWN} FROM rows")
def round_trip_mp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_back(spark, sf_dir, "mp4", kinds="vide,soun", codecs="vp09,sowt"), "seq", "pts", "keyframe")


@query(f"{ROWS} SELECT f, seq, seq // 2 AS pts, key AS keyframe, {_SHOWN} FROM rows")
def round_trip_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_back(spark, sf_dir, "avi", kinds="vids,auds"), "seq", "pts", "keyframe")


@query(f"{ROWS} SELECT f, seq, pts, ascii(body) % 2 = 0 AS keyframe, 0 AS stream_index, octet_length(encode(body))::INTEGER AS size, md5(body) AS md5 FROM rows")
def round_trip_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_back(spark, sf_dir, "ivf", width="2", height="2"), "seq", "pts", "keyframe")


@query(f"{ROWS} SELECT f, stream_index, seq, octet_length(encode(body))::INTEGER AS size, md5(body) AS md5 FROM rows WHERE seq BETWEEN 100 AND 199 AND stream_index = 1")
def packet_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each Matroska file the packets of a stretch, whose bytes alone are read."""
    folder = scratch(spark, "seek")
    sinks.write(_rows(spark, sf_dir, "mkv"), folder, "mkv", codecs="V_VP9,A_OPUS")
    return _shown(packet_index.read(spark, f"{folder}/*.mkv", where="seq between 100 and 199 and stream_index = 1"), "seq")


@query(f"{ROWS} SELECT f, stream_index, count(*) AS packets, sum(octet_length(encode(body)))::BIGINT AS bytes, sum(CASE WHEN key THEN 1 ELSE 0 END)::BIGINT AS keyframes, max(pts) - min(pts) AS span FROM rows GROUP BY 1, 2")
def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files hold, from their packet indexes; no packet is read."""
    folder = scratch(spark, "probe")
    sinks.write(_rows(spark, sf_dir, "webm"), folder, "webm", codecs="V_VP9,A_OPUS")
    found = packet_index.index(spark, f"{folder}/*.webm").withColumn("f", _number())
    return found.groupBy("f", "stream_index").agg(F.count("*").alias("packets"), F.sum("size").cast("long").alias("bytes"), F.sum(F.col("keyframe").cast("long")).alias("keyframes"), (F.max("pts") - F.min("pts")).alias("span"))


#: Bytes of audio that the samples of a stream make, sixteen bits each.
_PCM = f"WITH {views.SAMPLES} SELECT stream AS f, i // 16 AS seq, (count(*) * 2)::INTEGER AS size, count(*) AS duration, string_agg(x, ',' ORDER BY i) AS samples FROM samples GROUP BY 1, 2"


def _bytes_of(samples: DataFrame, suffix: str) -> DataFrame:
    from ..operators.resample import encode_pcm

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"])
    packets = samples.groupBy("stream", F.expr("i div 16").alias("seq")).agg(encode_pcm(ordered).alias("data"))
    return packets.select(F.format_string(f"%d.{suffix}", "stream").alias("file"), F.lit(0).alias("stream_index"), "seq", F.col("seq").alias("pts"), F.col("seq").alias("dts"), F.lit(True).alias("keyframe"), "data")


@query(_PCM)
def round_trip_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet per second of audio at sixteen samples a second."""
    from ..operators.resample import decode_pcm

    back = _back(spark, sf_dir, "wav", _bytes_of(views.samples(spark, sf_dir), "wav"), rate="16")
    return back.select(_number(), "seq", F.octet_length("data").alias("size"), "duration", F.array_join(decode_pcm(F.col("data")), ",").alias("samples"))


@query(f"WITH {views.FRAMES} SELECT frame_no // 500 AS f, frame_no % 500 AS seq, 64 AS size, array_to_string(p, ',') AS plane FROM frames")
def round_trip_y4m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).select(F.format_string("%d.y4m", F.expr("frame_no div 500")).alias("file"), F.lit(0).alias("stream_index"), (F.col("frame_no") % 500).alias("seq"), (F.col("frame_no") % 500).alias("pts"), (F.col("frame_no") % 500).alias("dts"), F.lit(True).alias("keyframe"), views.to_binary(F.col("p")).alias("data"))
    back = _back(spark, sf_dir, "y4m", rows, width="8", height="8", colour="mono")
    values = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda k: F.conv(F.hex(F.substring(F.col("data"), k, F.lit(1))), 16, 10))
    return back.select(_number(), "seq", F.octet_length("data").alias("size"), F.array_join(values, ",").alias("plane"))


_SEGMENTED = f"""WITH RECURSIVE {_ROW.replace("rows AS", "base AS", 1)}, fold AS (SELECT f, seq, pts, body, pts AS start, 0 AS segment FROM base WHERE seq = 0
UNION ALL SELECT b.f, b.seq, b.pts, b.body, CASE WHEN s THEN b.pts ELSE w.start END, w.segment + s::INTEGER FROM (SELECT v.f, v.seq, v.start, v.segment, (n.key AND n.pts - v.start >= 4000) OR n.pts - v.start >= 9000 AS s FROM fold v JOIN base n ON n.f = v.f AND n.seq = v.seq + 1) w JOIN base b ON b.f = w.f AND b.seq = w.seq + 1)"""


@query(f"{_SEGMENTED} SELECT f AS stream, segment, count(*) AS packets, sum(octet_length(encode(body)))::BIGINT AS bytes FROM fold GROUP BY 1, 2")
def hls_segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of HLS packages, read back."""
    folder = scratch(spark, "hls")
    rows = _rows(spark, sf_dir, "x").withColumn("stream", F.regexp_extract("file", r"^(\d+)", 1).cast("long")).withColumn("stream_index", F.lit(0)).withColumn("size", F.octet_length("data").cast("long"))
    numbers = C.segment_numbers(rows, 4000, 9000)
    sinks.write(packages.with_segments(rows.drop("file"), numbers), folder, "ts", kinds="0x1B")
    back = packet_index.read(spark, f"{folder}/*/*.ts")
    part = lambda k: F.regexp_extract("file", r"(\d+)/segment_(\d+)\.ts$", k).cast("long")
    return back.groupBy(part(1).alias("stream"), part(2).cast("int").alias("segment")).agg(F.count("*").alias("packets"), F.sum("size").cast("long").alias("bytes"))


# Event time


@query("""SELECT stream, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS packets, CAST(sum(size) AS BIGINT) AS size FROM
(SELECT *, sum(n) OVER (PARTITION BY stream ORDER BY ts, event_id) AS g FROM (SELECT user_id AS stream, ts, event_id, CAST(round(value * 100) AS BIGINT) AS size, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY stream, g""")
def packet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("size"))
    made = event_time.sessions(rows, "6 hours")
    return made.select("stream", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "packets", "size")


# Frames


@query(f"WITH {views.FRAMES}, h AS (SELECT frame_no, list_transform(range(40, 64), lambda k: CASE WHEN p[k + 1] > list_sum(p) // 64 THEN 1 ELSE 0 END) AS b FROM frames), c AS (SELECT b, min(frame_no) AS frame_no FROM h GROUP BY b), d AS (SELECT x.frame_no AS a, y.frame_no AS b, len(list_filter(range(24), lambda k: x.b[k + 1] <> y.b[k + 1])) AS distance FROM c x JOIN c y ON x.frame_no < y.frame_no) SELECT a, b, distance::INTEGER AS distance FROM d WHERE distance <= 4")
def hash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different average hashes, of the last three rows of pixels, within four bits."""
    lower = pixels.average_hash("p").bitwiseAND(F.lit((1 << 24) - 1))
    return neighbours.neighbours(views.frames(spark, sf_dir).select("frame_no", lower.alias("hash")), 4, bits=24)


_NOISE = "((((frame_no * 7919 + k + 12345) % 2147483648) * 2654435761) % 4294967296)"


@query(f"WITH {views.FRAMES}, x AS (SELECT frame_no, list_transform(range(64), lambda k: [p[k + 1] * 1023 // 255, {_NOISE}]) AS t FROM frames), y AS (SELECT frame_no, list_transform(t, lambda v: [v[1], ((xor(v[2], v[2] >> 15) * 1103515245) % 4294967296) >> 20]) AS t FROM x) SELECT frame_no, array_to_string(list_transform(t, lambda v: least(v[1] + (v[2] & 15), 1023) * 255 // 1023), ',') AS plane FROM y")
def random_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).select("frame_no", pixels.random_dither(pixels.to_ten_bits(F.col("p")), F.col("frame_no")).alias("p"))
    return rows.select("frame_no", F.array_join("p", ",").alias("plane"))


_MOTION = f"""WITH {views.YUV}, pairs AS (SELECT a.stream, a.frame_no, a.d AS a, b.d AS b FROM yuv a JOIN yuv b ON b.stream = a.stream AND b.frame_no = a.frame_no + 1),
cost AS (SELECT stream, frame_no, y // 4 AS j, x // 4 AS i, dy, dx, sum(abs(a[8 * y + x + 1] - b[8 * greatest(0, least(7, y + dy)) + greatest(0, least(7, x + dx)) + 1])) AS c FROM pairs, range(8) u(y), range(8) v(x), range(-2, 3) s(dy), range(-2, 3) t(dx) GROUP BY ALL),
best AS (SELECT stream, frame_no, j, i, arg_min([dx, dy], c * 100 + (dy + 2) * 5 + dx + 2) AS m FROM cost GROUP BY ALL),
half AS (SELECT stream, frame_no, list(CAST(floor(0.5::DOUBLE * a[8 * y + x + 1] + 0.5::DOUBLE * b[8 * greatest(0, least(7, y + CAST(trunc(m[2] * 0.5::DOUBLE) AS BIGINT))) + greatest(0, least(7, x + CAST(trunc(m[1] * 0.5::DOUBLE) AS BIGINT))) + 1]) AS INTEGER) ORDER BY y, x) AS p FROM pairs JOIN best USING (stream, frame_no), range(8) u(y), range(8) v(x) WHERE j = y // 4 AND i = x // 4 GROUP BY ALL),
made AS (SELECT stream, 2 * frame_no + 1 AS frame_no, p || list_transform(range(64, 96), lambda k: CAST(floor(0.5::DOUBLE * a[k + 1] + 0.5::DOUBLE * b[k + 1]) AS INTEGER)) AS p FROM half JOIN pairs USING (stream, frame_no) UNION ALL SELECT stream, 2 * frame_no, d FROM yuv UNION ALL SELECT stream, 2 * frame_no + 1, d FROM yuv JOIN (SELECT stream, max(frame_no) AS frame_no FROM yuv GROUP BY 1) USING (stream, frame_no))
SELECT stream, frame_no, array_to_string(p, ',') AS plane FROM made"""


@query(_MOTION)
def motion_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames played at half the speed, those between made by block motion."""
    made = interpolation.slow_motion(views.yuv_frames(spark, sf_dir), 0.5, 4, 2)
    values = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda k: F.conv(F.hex(F.substring(F.col("data"), k, F.lit(1))), 16, 10))
    return made.select("stream", "frame_no", F.array_join(values, ",").alias("plane"))


@query("SELECT event_id AS seq, u::INTEGER AS unit, (event_id + 7 * u) % 32 AS type, ((event_id // 3) % 4)::INTEGER AS ref_idc, (1 + (event_id + u) % 23)::INTEGER AS size FROM events, range(3) t(u) WHERE u <= event_id % 3")
def nal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of packets whose heads and sizes are made of the events."""
    head = lambda u: F.hex(((F.col("event_id") / 3).cast("long") % 4 * 32 + (F.col("event_id") + 7 * u) % 32).cast("long"))
    unit = lambda u: F.concat(F.lit("00000001" if u % 2 else "000001"), F.lpad(head(u), 2, "0"), F.expr(f"repeat('AB', cast((event_id + {u}) % 23 as int))"))
    data = F.unhex(F.concat(*[F.when(F.col("event_id") % 3 >= u, unit(u)).otherwise("") for u in range(3)]))
    packets = views.table(spark, sf_dir, "events").select(F.lit("x").alias("file"), F.lit(0).alias("stream_index"), F.col("event_id").alias("seq"), data.alias("data"))
    return nal.units(packets).select("seq", "unit", F.col("type").cast("long").alias("type"), "ref_idc", "size")


_STEP = [[46341, 16], [39200, 16], [35468, 15]]


def _sql_butterflies(x: str) -> str:
    """The transform of a list of eight numbers; products are shifted back downwards."""
    by = lambda v, k: f"floor(({v}) * {_STEP[k][0]} / {1 << _STEP[k][1]}.0::DOUBLE)"
    s, d = [f"({x}[{k + 1}] + {x}[{8 - k}])" for k in range(4)], [f"({x}[{k + 1}] - {x}[{8 - k}])" for k in range(4)]
    a, b = f"({by(d[3], 0)} + {by(d[2], 1)})", f"({by(d[3], 1)} - {by(d[2], 0)})"
    tilt, bend = f"({s[0]} - {s[3]})", by(f"{s[1]} - {s[2]}", 2)
    return f"[{s[0]} + {s[3]} + {s[1]} + {s[2]}, {d[0]} + {a}, {tilt} + {bend}, {d[0]} - {a}, {s[0]} + {s[3]} - {s[1]} - {s[2]}, {d[1]} + {b}, {tilt} - {bend}, {d[1]} - {b}]"


@query(f"""WITH {views.YUV}, c AS (SELECT stream, frame_no, list_transform(range(8), lambda r: list_transform(d[8 * r + 1 : 8 * r + 8], lambda v: (v - 128)::DOUBLE)) AS q FROM yuv),
h AS (SELECT stream, frame_no, list_transform(q, lambda x: {_sql_butterflies("x")}) AS q FROM c),
v AS (SELECT stream, frame_no, list_transform(list_transform(range(8), lambda k: list_transform(q, lambda x: x[k + 1])), lambda x: {_sql_butterflies("x")}) AS q FROM h)
SELECT stream, frame_no, array_to_string(list_transform(range(64), lambda k: CAST(floor((q[k % 8 + 1][k // 8 + 1] + 4) / 8) AS INTEGER)), ',') AS coefficients FROM v""")
def block_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.luma_blocks(views.yuv_frames(spark, sf_dir))
    return rows.select("stream", "frame_no", F.array_join("coefficients", ",").alias("coefficients"))
