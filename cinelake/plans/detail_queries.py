"""Queries of trajectories, grids, catalogs, proxies, metrics, low-latency playlists and filter chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FORMATS
from ..operators import catalog as K
from ..operators import control as C
from ..operators import motion as M
from ..operators import resample
from ..operators.chain import FilterChain
from . import views
from .registration import query

TR = f"{views.STATS}, tr AS (SELECT stream, idx, motion::DOUBLE AS dx, complexity::DOUBLE AS dy, (bits % 100) / 1000.0::DOUBLE AS angle, 1 + complexity / 100.0::DOUBLE AS scale FROM stats)"
LOW = f"WITH RECURSIVE {TR}, low AS (SELECT * FROM tr WHERE idx = 1 UNION ALL SELECT tr.stream, tr.idx, {', '.join(f'(1 - 0.7::DOUBLE) * tr.{c} + 0.7::DOUBLE * low.{c}' for c in M.PARTS)} FROM low JOIN tr ON tr.stream = low.stream AND tr.idx = low.idx + 1)"


def _trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame_stats(spark, sf_dir).select("stream", "idx", F.col("motion").cast("double").alias("dx"), F.col("complexity").cast("double").alias("dy"), (F.col("bits") % 100 / 1000.0).alias("angle"), (1 + F.col("complexity") / 100.0).alias("scale"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("stream", "idx", *[F.round(c, 9).alias(c) for c in M.PARTS])


_OUT = ", ".join(f"round({c}, 9) AS {c}" for c in M.PARTS)


@query(f"WITH {TR} SELECT stream, idx, {', '.join(f'round({c} + (avg({c}) OVER w - {c}) * 0.8::DOUBLE, 9) AS {c}' for c in M.PARTS)} FROM tr WINDOW w AS (PARTITION BY stream ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def trajectory_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.smooth(_trajectory(spark, sf_dir), 5, 0.8))


@query(f"{LOW} SELECT stream, idx, {_OUT} FROM low")
def trajectory_low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.low_pass(_trajectory(spark, sf_dir), 0.7))


@query(f"{LOW} SELECT stream, idx, round(low.dx - tr.dx, 9) AS dx, round(low.dy - tr.dy, 9) AS dy, round(low.angle - tr.angle, 9) AS angle, round(low.scale / tr.scale, 9) AS scale FROM low JOIN tr USING (stream, idx)")
def stabilizing_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trajectory(spark, sf_dir)
    return _rounded(M.stabilizing(rows, M.low_pass(rows, 0.7)))


@query(f"WITH {TR} SELECT stream, idx, CAST(r AS INTEGER) AS row, round(dx * (r / 4.0::DOUBLE * 0.5), 9) AS dx, round(dy * (r / 4.0::DOUBLE * 0.5), 9) AS dy, round(angle * (r / 4.0::DOUBLE * 0.5), 9) AS angle, round(1 + (scale - 1) * (r / 4.0::DOUBLE * 0.5), 9) AS scale FROM tr, range(0, 4) t(r)")
def rolling_shutter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.scanline(_trajectory(spark, sf_dir), 4, 0.5)
    return rows.select("stream", "idx", "row", *[F.round(c, 9).alias(c) for c in M.PARTS])


@query(f"WITH RECURSIVE {views.FRAMES}, walk AS (SELECT 0::BIGINT AS frame_no UNION ALL SELECT frame_no + [3, 2, 3, 2][frame_no % 4 + 1] FROM walk WHERE frame_no < (SELECT max(frame_no) FROM frames)) SELECT frame_no FROM frames SEMI JOIN walk USING (frame_no)")
def telecine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inverse_pulldown(views.frames(spark, sf_dir), "3:2").select("frame_no")


@query(f"WITH {views.STATS}, n AS (SELECT stream, count(*) AS n FROM stats GROUP BY 1), k AS (SELECT stream, unnest(range(CAST(round(n / 0.4::DOUBLE) AS BIGINT))) AS k FROM n) SELECT stream, k AS out_frame, CAST(floor(k * 0.4::DOUBLE) AS BIGINT) AS low, CAST(floor(k * 0.4::DOUBLE) AS BIGINT) + 1 AS high, round(k * 0.4::DOUBLE - floor(k * 0.4::DOUBLE), 6) AS part FROM k")
def slow_motion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.frame_stats(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"))
    return M.slow_motion_grid(sources, 0.4).withColumn("part", F.round("part", 6))


_CODECS = ", ".join(f"('{i}', '{n}', '{m}')" for i, n, m in K.CODECS)


#: The codec of each supplier's files, and the names of their files.
_IDS = [c[0] for c in K.CODECS]
_SUFFIXES = [FORMATS[name][0] for name, *_ in K.DETAILS]


@query(f"WITH t(id, name, media) AS (VALUES {_CODECS}) SELECT s_suppkey, id, name, media FROM (SELECT s_suppkey, {_IDS}[s_suppkey % {len(_IDS)} + 1] AS id FROM supplier) JOIN t USING (id) WHERE media = 'audio'")
def codec_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' codecs that are listed as audio."""
    used = views.table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, _IDS)), (F.col("s_suppkey") % len(_IDS) + 1).cast("int")).alias("id"))
    return used.join(F.broadcast(K.codecs(spark, "audio")), "id").select("s_suppkey", "id", "name", "media")


_DETAILS = ", ".join(f"('{FORMATS[n][0]}', '{n}', '{long}', '{','.join(mime)}', {', '.join(str(f).lower() for f in flags)})" for n, long, mime, flags in K.DETAILS)


@query(f"WITH t(ext, name, long_name, mime_types, seekable, multi_stream, timestamps, metadata) AS (VALUES {_DETAILS}) SELECT path, name, long_name, mime_types, seekable, multi_stream, timestamps, metadata FROM (SELECT 'clip' || s_suppkey || '.' || {_SUFFIXES}[s_suppkey % {len(_SUFFIXES)} + 1] AS path, {_SUFFIXES}[s_suppkey % {len(_SUFFIXES)} + 1] AS ext FROM supplier) JOIN t USING (ext) WHERE seekable AND multi_stream")
def format_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formats of the suppliers' files that can be sought in and hold several streams."""
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("s_suppkey") % len(_SUFFIXES) + 1).cast("int"))
    files = views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("clip"), F.col("s_suppkey").cast("string"), F.lit("."), suffix).alias("path"))
    return K.with_format(files, spark).filter("seekable AND multi_stream").drop("extensions").withColumn("mime_types", F.array_join("mime_types", ","))


@query("SELECT p_partkey, CASE WHEN c < 1 OR c > 10000 THEN 'MaxCLL' WHEN f < 1 OR f > c THEN 'MaxFALL' END AS error FROM (SELECT p_partkey, p_partkey % 130 * 80 AS c, p_size * 10 AS f FROM part)")
def light_level_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", K.light_level_error(F.col("p_partkey") % 130 * 80, F.col("p_size") * 10).alias("error"))


@query("""SELECT p_partkey, w // 4 AS width, h // 4 AS height, CAST(floor(round((w // 4) * (h // 4) * 0.05 * 30, 3)) AS BIGINT) AS h265, CASE WHEN h <= 540 THEN 10000000 WHEN h <= 720 THEN 18000000 WHEN h <= 1080 THEN 36000000 ELSE 45000000 END AS prores,
CASE WHEN h <= 540 THEN 4000000 WHEN h <= 720 THEN 6000000 WHEN h <= 1080 THEN 8000000 ELSE 12000000 END AS dnxhr FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 23 AS h FROM part)""")
def proxy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), (F.col("p_size") * 23).alias("h"))
    size = K.proxy_size(F.col("w"), F.col("h"), "quarter")
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), K.proxy_bitrate(size["width"], size["height"], "h265").alias("h265"), K.proxy_bitrate(F.col("w"), F.col("h"), "prores").alias("prores"), K.proxy_bitrate(F.col("w"), F.col("h"), "dnxhr").alias("dnxhr"))


@query("""SELECT 'p' || p_partkey AS path, '{"original_path":"p' || p_partkey || '","original_resolution":[' || p_size * 40 || ',' || p_size * 23 || '],"proxy_resolution":[' || p_size * 20 || ',' || p_size * 23 // 2 || '],"scale_factor":0.5,"codec":"h264","timecode_offset":' || CASE WHEN p_partkey % 2 = 0 THEN '"01:00:00:00"' ELSE 'null' END || '}' AS document FROM part""")
def proxy_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 40, F.col("p_size") * 23
    size = K.proxy_size(w, h, "half")
    rows = views.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), w.alias("width"), h.alias("height"), size["width"].alias("proxy_width"), size["height"].alias("proxy_height"), F.lit(0.5).alias("scale"), F.lit("h264").alias("codec"), F.when(F.col("p_partkey") % 2 == 0, "01:00:00:00").alias("offset"))
    return K.proxy_sidecar(rows)


_COUNTS = f"""WITH {views.JOBS}, {views.WORKERS}, m AS (SELECT count(*) AS jobs_total, count(*) FILTER (state = 'running') AS jobs_running, count(*) FILTER (state = 'complete') AS jobs_completed, count(*) FILTER (state = 'failed') AS jobs_failed, count(*) FILTER (state = 'cancelled') AS jobs_cancelled, (SELECT count(*) FROM workers) AS worker_count,
 CAST(sum(bytes) FILTER (state = 'complete') AS BIGINT) AS bytes_processed, sum(ms) FILTER (state = 'complete') / 1000.0::DOUBLE AS encoding_time_seconds, count(*) FILTER (state = 'queued') AS queue_depth FROM jobs)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.job_metrics(views.jobs(spark, sf_dir), views.workers(spark, sf_dir))


_FIELDS = " || ',' || ".join(f"'\"{n}\":' || {n}" for n in K.METRICS)


@query(f"{_COUNTS} SELECT '{{' || {_FIELDS} || '}}' AS document FROM m")
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.metrics_json(_metrics(spark, sf_dir))


_LINES = " || chr(10) || ".join(f"'# HELP media_{n} {text}' || chr(10) || '# TYPE media_{n} {kind}' || chr(10) || 'media_{n} ' || {n} || chr(10)" for n, (kind, text) in K.METRICS.items())


@query(f"{_COUNTS} SELECT {_LINES} AS body FROM m")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.metrics_text(_metrics(spark, sf_dir))


@query(f"WITH {views.PACKETS} SELECT stream, size AS position, keyframe FROM packets WHERE seq = 10")
def index_exact_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.find_frame(views.packets(spark, sf_dir).select("stream", F.col("seq").alias("frame_no"), F.col("size").alias("position"), "keyframe"), 10)


@query(f"WITH {views.PACKETS} SELECT stream, seq AS frame_no, size AS position FROM packets WHERE keyframe")
def index_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keyframes(views.packets(spark, sf_dir)).select("stream", F.col("seq").alias("frame_no"), F.col("size").alias("position"))


@query(f"WITH {views.FRAMES} SELECT frame_no, array_to_string([CAST(list_sum([(p[8 * b + k + 1] & 1) << (7 - k) for k in range(8)]) AS INTEGER) for b in range(4)], ',') AS payload FROM frames")
def lsb_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("frame_no", F.array_join(F.transform(K.lsb_payload(F.col("p"), 4), lambda v: v.cast("string")), ",").alias("payload"))


@query(f"WITH {views.STATS} SELECT stream % 50 AS key, CASE idx % 2 WHEN 0 THEN 'a' ELSE 'b' END AS curve, round(avg(30 + ln(bits) + motion / 50.0::DOUBLE), 6) AS psnr FROM stats GROUP BY 1, 2")
def average_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.frame_stats(spark, sf_dir).select((F.col("stream") % 50).alias("key"), F.when(F.col("idx") % 2 == 0, "a").otherwise("b").alias("curve"), (30 + F.log(F.col("bits").cast("double")) + F.col("motion") / 50).alias("psnr"))
    return C.average_psnr(points).withColumn("psnr", F.round("psnr", 6))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).select("stream", F.expr("seq div 4").alias("segment"), (F.col("seq") % 4).alias("part"), F.col("size").alias("duration"), F.col("keyframe").alias("independent"))


_PARTS = f"WITH {views.PACKETS}, parts AS (SELECT stream, seq // 4 AS segment, seq % 4 AS part, size AS duration, keyframe FROM packets)"


@query(f"{_PARTS} SELECT stream, segment, CAST(sum(duration) AS BIGINT) AS duration FROM parts GROUP BY 1, 2")
def low_latency_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.part_durations(_parts(spark, sf_dir))


_NL = "chr(10)"


@query(f"""{_PARTS}, seg AS (SELECT stream, segment, string_agg(printf('#EXT-X-PART:DURATION=%.5f,URI="segment_%05d.%d.m4s"', duration / 1000.0, segment, part) || CASE WHEN keyframe THEN ',INDEPENDENT=YES' ELSE '' END, {_NL} ORDER BY part) || {_NL} || printf('#EXTINF:%.3f,', sum(duration) / 1000.0) || {_NL} || printf('segment_%05d.m4s', segment) || {_NL} AS e, max(part) AS l FROM parts GROUP BY 1, 2)
SELECT stream, '#EXTM3U' || {_NL} || '#EXT-X-VERSION:9' || {_NL} || '#EXT-X-TARGETDURATION:4' || {_NL} || '#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK=1.500' || {_NL} || '#EXT-X-PART-INF:PART-TARGET=0.500' || {_NL} || '#EXT-X-MEDIA-SEQUENCE:' || count(*) || {_NL} || string_agg(e, '' ORDER BY segment)
 || printf('#EXT-X-PRELOAD-HINT:TYPE=PART,URI="segment_%05d.%d.m4s"', max(segment), arg_max(l, segment) + 1) || {_NL} || printf('#EXT-X-RENDITION-REPORT:URI="s%d.m3u8",LAST-MSN=%d', stream, max(segment)) || CASE WHEN stream % 2 = 0 THEN ',LAST-PART=' || arg_max(l, segment) ELSE '' END || {_NL} AS playlist FROM seg GROUP BY stream""")
def low_latency_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    last = parts.groupBy("stream").agg(F.max(F.struct("segment", "part")).alias("l"))
    reports = last.select("stream", F.format_string("s%d.m3u8", "stream").alias("uri"), F.col("l.segment").alias("last_segment"), F.when(F.col("stream") % 2 == 0, F.col("l.part")).alias("last_part"))
    return C.low_latency_playlist(parts, 4000, 500, reports=reports)


@query("SELECT '#EXTM3U' || chr(10) || '#EXT-X-VERSION:9' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) || chr(10) || string_agg(printf('#EXT-X-STREAM-INF:BANDWIDTH=%d,AVERAGE-BANDWIDTH=%d,RESOLUTION=%dx%d,FRAME-RATE=25', (n_nationkey + 1) * 100000, (n_nationkey + 1) * 90000, (n_nationkey + 1) * 160, (n_nationkey + 1) * 90) || chr(10) || n_name || '.m3u8' || chr(10), '' ORDER BY n_nationkey) AS playlist FROM nation")
def low_latency_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") + 1
    return C.low_latency_master(views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), (n * 100000).alias("bits"), (n * 160).alias("width"), (n * 90).alias("height"), F.lit(25).alias("fps")))


@query(f"WITH {views.CUES}, c AS (SELECT track, ordinal, start_ms, CASE WHEN ordinal % 3 = 0 THEN end_ms + 500 * (ordinal % 2) END AS e FROM cues), n AS (SELECT *, lead(start_ms) OVER (PARTITION BY track ORDER BY start_ms, ordinal) AS nx FROM c) SELECT track, ordinal, start_ms, coalesce(e, nx) AS end_ms, coalesce(e > nx, false) AS overlaps FROM n")
def chapter_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("ordinal") % 3 == 0, F.col("end_ms") + 500 * (F.col("ordinal") % 2))
    return C.check_chapters(views.cues(spark, sf_dir).select("track", "ordinal", "start_ms", end.alias("end_ms")))


@query(f"WITH {views.JOBS}, {views.WORKERS} SELECT worker_id, state = 'ready' AND running < most AS accepts, beat_age < 30 AS healthy, list_contains(codecs, 3) AND list_contains(hws, 'gpu') AS handles FROM workers")
def worker_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.worker_checks(views.workers(spark, sf_dir), F.lit(3), F.lit("gpu"), 30)


_TAPS = resample.low_pass(128, 2)[::3].tolist()


@query(f"WITH {views.SAMPLES}, t AS (SELECT unnest({_TAPS!r}::DOUBLE[]) AS tap, unnest(range({len(_TAPS)})) AS j), n AS (SELECT stream, count(*) AS n FROM samples GROUP BY 1), k AS (SELECT stream, unnest(range((n * 2 + 2) // 3)) AS k FROM n) SELECT k.stream, k AS i, round(sum(s.x * tap), 6) AS y FROM k, t JOIN samples s ON s.stream = k.stream AND s.i = (k.k - t.j) * 3 // 2 WHERE k.k >= t.j GROUP BY 1, 2")
def polyphase_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.polyphase(views.samples(spark, sf_dir), 48_000, 32_000).withColumn("y", F.round("y", 6))


@query(f"WITH {views.FRAMES}, o AS (SELECT frame_no, unnest(range(frame_no % 3 + 1)) AS output, p[1] AS v FROM frames) SELECT frame_no, CAST(output AS INTEGER) AS output, v + CAST(output AS INTEGER) AS v FROM o WHERE (v + output) % 2 = 0")
def chain_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame gives up to three outputs, of which a later filter keeps the even ones."""
    times = F.explode(F.sequence(F.lit(0), (F.col("frame_no") % 3).cast("int")))
    chain = FilterChain().add("repeat", lambda d: d.select("frame_no", times.alias("output"), "v")).add("lift", lambda d: d.withColumn("v", F.col("v") + F.col("output"))).add("even", lambda d: d.filter("v % 2 = 0"))
    return chain.fan_out(views.frames(spark, sf_dir).select("frame_no", F.get("p", F.lit(0)).alias("v")))


@query(f"""WITH {views.PACKETS}, own AS (SELECT 'f' || stream % 10 || CASE WHEN stream % 2 = 0 THEN '.mkv' ELSE '.bin' END AS file, stream // 10 AS stream_index, pts, size, keyframe FROM packets),
st AS (SELECT file, stream_index, count(*) AS n, CAST(sum(keyframe::INTEGER) AS BIGINT) AS k, CAST(sum(size) AS BIGINT) AS size, max(pts) - min(pts) AS d FROM own GROUP BY 1, 2),
f AS (SELECT file, max(d) FILTER (d > 0) AS d, CAST(sum(size) AS BIGINT) AS size, string_agg('{{"index":' || stream_index || ',"packets":' || n || ',"keyframes":' || k || ',"size":' || size || ',"duration":' || d || '}}', ',' ORDER BY stream_index) AS streams FROM st GROUP BY 1)
SELECT file, '{{"filename":"' || file || '","format":{{"name":' || CASE WHEN file LIKE '%.mkv' THEN '"matroska"' ELSE 'null' END || ',"duration":' || coalesce(d::VARCHAR, 'null') || ',"size":' || size || ',"bit_rate":' || coalesce((size * 8000 // d)::VARCHAR, 'null') || '}},"streams":[' || streams || ']}}' AS document FROM f""")
def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("stream") % 2 == 0, ".mkv").otherwise(".bin")
    rows = views.packets(spark, sf_dir).select(F.concat(F.lit("f"), (F.col("stream") % 10).cast("string"), suffix).alias("file"), F.expr("stream div 10").alias("stream_index"), "pts", "size", "keyframe")
    return K.probe(rows)
