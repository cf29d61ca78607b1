"""Queries over packets, encoder statistics and the transcode queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import documents as D
from ..operators.islands import asof_join
from ..operators.motion import stability
from . import views
from .registration import query

PK, ST, JB = f"WITH {views.PACKETS}", f"WITH {views.STATS}", f"WITH {views.JOBS}, {views.WORKERS}"
SEG = f"""WITH RECURSIVE {views.PACKETS}, fold AS (SELECT stream, seq, pts, size, pts AS start, 0 AS segment FROM packets WHERE seq = 0
UNION ALL SELECT p.stream, p.seq, p.pts, p.size, CASE WHEN s THEN p.pts ELSE start END, segment + s::INTEGER FROM (SELECT f.stream, f.seq + 1 AS nx, f.start, f.segment, p.pts, (p.keyframe AND p.pts - f.start >= 21600000) OR p.pts - f.start >= 86400000 AS s FROM fold f JOIN packets p ON p.stream = f.stream AND p.seq = f.seq + 1) t JOIN packets p ON p.stream = t.stream AND p.seq = t.nx),
segs AS (SELECT stream, segment, min(start) AS start, max(pts) - min(start) AS duration, CAST(sum(size) AS BIGINT) AS size, count(*) AS packets FROM fold GROUP BY 1, 2)"""


@query(f"{PK} SELECT event_id, 0 AS stream, pts, size FROM packets WHERE stream = 7")
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).filter("stream = 7").select("event_id", F.lit(0).alias("stream"), "pts", "size")


@query(f"{PK} SELECT stream, max(pts) - min(pts) AS duration, CAST(sum(size) AS BIGINT) AS size, count(*) AS packets, CAST(sum(keyframe::INTEGER) AS BIGINT) AS keyframes, round(sum(size) * 8000.0 / (max(pts) - min(pts)), 6) AS bit_rate FROM packets GROUP BY 1 HAVING count(*) > 1")
def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.max("pts") - F.min("pts")
    return views.packets(spark, sf_dir).groupBy("stream").agg(span.alias("duration"), F.sum("size").alias("size"), F.count("*").alias("packets"), F.sum(F.col("keyframe").cast("long")).alias("keyframes"), F.round(F.sum("size") * 8000.0 / F.nullif(span, F.lit(0)), 6).alias("bit_rate")).filter("packets > 1")


@query(f"{PK} SELECT stream, CAST(floor(min(duration) / 1000) AS BIGINT) AS seconds FROM (SELECT stream, max(pts) - min(pts) AS duration FROM packets GROUP BY 1) GROUP BY stream")
def container_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).groupBy("stream").agg(F.floor((F.max("pts") - F.min("pts")) / 1000).alias("seconds"))


@query(f"{PK} SELECT event_id, stream, seq, max(CASE WHEN keyframe THEN seq END) OVER (PARTITION BY stream ORDER BY seq) AS key_seq FROM packets")
def nearest_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = W.partitionBy("stream").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return views.packets(spark, sf_dir).select("event_id", "stream", "seq", F.max(F.when(F.col("keyframe"), F.col("seq"))).over(over).alias("key_seq"))


@query(f"{PK}, k AS (SELECT stream, seq, pts FROM packets WHERE keyframe), q AS (SELECT event_id, stream, pts + 3600000 AS pts FROM packets WHERE kind = 'view') SELECT q.event_id, q.stream, q.pts, k.pts AS key_pts, k.seq AS key_seq FROM q ASOF LEFT JOIN k ON q.stream = k.stream AND q.pts >= k.pts")
def keyframe_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.packets(spark, sf_dir)
    asked = rows.filter("kind = 'view'").select("event_id", "stream", (F.col("pts") + 3600000).alias("pts"))
    found = asof_join(asked, rows.filter("keyframe").select("stream", "pts", "seq"), "stream", "pts", "seq")
    return found.select("event_id", "stream", "pts", F.col("right_pts").alias("key_pts"), F.col("right_seq").alias("key_seq"))


@query(f"{SEG} SELECT stream, segment, start, duration, size, packets FROM segs")
def segmenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments(views.packets(spark, sf_dir), 21_600_000, 86_400_000)


@query(f"{SEG} SELECT stream, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:21600' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || count(*) || chr(10) || string_agg(printf('#EXTINF:%.3f,', duration / 1000.0) || chr(10) || printf('segment_%05d.ts', segment), chr(10) ORDER BY segment) || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS playlist FROM segs GROUP BY stream")
def hls_media_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.media_playlist(C.segments(views.packets(spark, sf_dir), 21_600_000, 86_400_000), 21_600)


@query("SELECT '#EXTM3U' || chr(10) || string_agg(printf('#EXT-X-STREAM-INF:BANDWIDTH=%d,RESOLUTION=%dx%d', (n_nationkey + 1) * 100000, (n_nationkey + 1) * 160, (n_nationkey + 1) * 90) || chr(10) || n_name || '.m3u8', chr(10) ORDER BY n_nationkey) || chr(10) AS playlist FROM nation")
def hls_master_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") + 1
    return C.master_playlist(views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), (n * 100000).alias("bits"), (n * 160).alias("width"), (n * 90).alias("height")))


@query(f"{SEG} SELECT stream, n_nationkey AS profile, segment, printf('%d/segment_%05d.m4s', n_nationkey, segment) AS url FROM segs CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3)")
def dash_segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.segments(views.packets(spark, sf_dir), 21_600_000, 86_400_000)
    profile = F.explode(F.array(*map(F.lit, range(3))))  # profiles are a bounded list
    return made.select("stream", profile.alias("profile"), "segment").withColumn("url", F.format_string("%d/segment_%05d.m4s", "profile", "segment"))


@query(f"{ST}, w AS (SELECT *, avg(complexity) OVER (PARTITION BY stream) AS m, avg(complexity) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM stats) SELECT stream, idx, round(greatest(500, least(3000, 1000 * CASE WHEN m = 0 THEN 1.0 ELSE (0.7 * complexity + 0.3 * a) / m END * CASE kind WHEN 'I' THEN 1.5 WHEN 'P' THEN 1.0 ELSE 0.7 END)), 8) AS budget FROM w")
def look_ahead_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frame_lines(spark, sf_dir).select("stream", *views.FRAME_ORDER, views.frame_index(), "kind", "complexity")
    return C.look_ahead_bitrate(frames, 3, 1000, views.FRAME_ORDER).select("stream", "idx", F.round("budget", 8).alias("budget"))


@query(f"{ST} SELECT stream, idx, round(greatest(0, least(51, 26 * avg(complexity) OVER (PARTITION BY stream) / greatest(complexity, 0.1) * CASE kind WHEN 'I' THEN 0.8 WHEN 'P' THEN 1.0 ELSE 1.2 END)), 6) AS q FROM stats")
def frame_quantizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantizer(views.frame_stats(spark, sf_dir), 26.0).select("stream", "idx", F.round("q", 6).alias("q"))


_BINS = ", ".join(f"CAST(sum((floor(complexity / 10.0 * 9.99) = {b})::INTEGER) AS BIGINT) AS bin{b}" for b in range(10))


@query(f"{ST} SELECT stream, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits, round(avg(complexity), 6) AS mean, max(complexity) AS peak, {_BINS} FROM stats GROUP BY stream")
def pass_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pass_statistics(views.frame_stats(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


_PLAN = f"""WITH RECURSIVE {views.STATS}, f AS (SELECT stream, idx, 1 AS since, 'I' AS planned FROM stats WHERE idx = 1
UNION ALL SELECT stream, idx, CASE planned WHEN 'I' THEN 1 ELSE since + 1 END, planned FROM (SELECT s.stream, s.idx, f.since, CASE WHEN (s.complexity >= 8 AND f.since >= 2) OR f.since >= 5 THEN 'I' WHEN f.since % 3 = 0 THEN 'P' ELSE 'B' END AS planned FROM f JOIN stats s ON s.stream = f.stream AND s.idx = f.idx + 1))"""


@query(f"{_PLAN} SELECT stream, idx, planned FROM f")
def gop_frame_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frame_stats(spark, sf_dir).select("stream", "idx", (F.col("complexity") >= 8).alias("scene"))
    return C.group_frame_types(frames, 5, least=2, between=2)


@query(f"{_PLAN} SELECT stream, count(*) AS frames, count(*) // 5 AS groups, max(idx) - max(idx) FILTER (planned = 'I') + 1 AS open, count(*) // greatest(count(*) // 5, 1) AS mean FROM f GROUP BY 1")
def gop_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_statistics(gop_frame_types(spark, sf_dir), 5)


@query(f"{ST} SELECT stream, idx, round(avg(motion) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS motion FROM stats")
def motion_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("stream").orderBy(*views.FRAME_ORDER).rowsBetween(-2, 0)
    return views.frame_lines(spark, sf_dir).select("stream", views.frame_index(), F.round(F.avg("motion").over(order), 6).alias("motion"))


@query(f"{ST}, d AS (SELECT stream, motion - lag(motion) OVER (PARTITION BY stream ORDER BY idx) AS d, motion FROM stats) SELECT stream, round(avg(motion), 6) AS mean, max(motion) AS most, round(1 / (1 + coalesce(avg(d * d), 0)), 6) AS smoothness FROM d GROUP BY stream")
def stabilization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stability(views.frame_lines(spark, sf_dir), order=views.FRAME_ORDER)
    return made.select("stream", F.round("mean", 6).alias("mean"), "most", F.round("smoothness", 6).alias("smoothness"))


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS spread, round(1000 / avg(value), 6) AS rate FROM events GROUP BY 1")
def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.stage_profile(views.table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), "stage", "value")
    return out.select("stage", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", F.round("spread", 6).alias("spread"), F.round("rate", 6).alias("rate"))


@query("SELECT event_type AS stage, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY total DESC LIMIT 3")
def bottleneck_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("total")).orderBy(F.col("total").desc()).limit(3)


@query(f"{JB} SELECT job_id, row_number() OVER (PARTITION BY codec ORDER BY priority DESC, created, job_id) AS place FROM jobs WHERE state = 'queued'")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("codec").orderBy(F.col("priority").desc(), "created", "job_id")
    return views.jobs(spark, sf_dir).filter("state = 'queued'").select("job_id", F.row_number().over(order).alias("place"))


@query(f"{JB} SELECT job_id, priority FROM jobs ORDER BY priority DESC, created, job_id LIMIT 25 OFFSET 50")
def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.jobs(spark, sf_dir).orderBy(F.col("priority").desc(), "created", "job_id").offset(50).limit(25).select("job_id", "priority")


_ASSIGN = f"""WITH RECURSIVE {views.JOBS}, {views.WORKERS}, able AS (SELECT worker_id, codecs, hws, row_number() OVER (ORDER BY worker_id) AS k FROM workers WHERE state = 'ready' AND running < most),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codec, hw ORDER BY priority DESC, created, job_id) AS r FROM jobs WHERE state = 'queued') WHERE r <= (SELECT count(*) FROM able)),
asked AS (SELECT worker_id, k, list(b.job_id ORDER BY b.priority DESC, b.created, b.job_id) AS wanted FROM able JOIN best b ON list_contains(codecs, b.codec) AND (b.hw IS NULL OR list_contains(hws, b.hw)) GROUP BY 1, 2),
fold AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS worker_id, NULL::BIGINT AS job_id, []::BIGINT[] AS taken
UNION ALL SELECT k, worker_id, job_id, list_append(taken, job_id) FROM (SELECT a.k, a.worker_id, f.taken, list_filter(a.wanted, lambda j: NOT list_contains(f.taken, j))[1]::BIGINT AS job_id FROM fold f JOIN asked a ON a.k = f.k + 1))"""


@query(f"{_ASSIGN} SELECT worker_id, job_id FROM fold WHERE job_id IS NOT NULL")
def job_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assign_jobs(views.jobs(spark, sf_dir), views.workers(spark, sf_dir))


@query(f"{JB} SELECT state, count(*) AS n, state IN ('complete', 'failed', 'cancelled') AS terminal, CAST(sum(bytes) AS BIGINT) AS bytes FROM jobs GROUP BY state")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.jobs(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).withColumn("terminal", F.col("state").isin("complete", "failed", "cancelled"))


@query(f"{JB} SELECT codec, round(CASE WHEN sum(ms) > 0 THEN sum(bytes)::DOUBLE / (sum(ms) / 1000.0) ELSE 0 END, 6) AS speed FROM jobs WHERE state = 'complete' GROUP BY codec")
def transfer_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transfer_speed(views.jobs(spark, sf_dir).filter("state = 'complete'"), "codec").withColumn("speed", F.round("speed", 6))


@query(f"{PK} SELECT stream, pts // 3600000 AS hour, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM packets GROUP BY 1, 2")
def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).groupBy("stream", F.expr("pts div 3600000").alias("hour")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query()
def bd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.when(F.col("idx") % 2 == 0, "a").otherwise("b")
    points = views.frame_stats(spark, sf_dir).select((F.col("stream") % 50).alias("key"), curve.alias("curve"), (F.col("bits") / 100).alias("rate"), (30 + F.log(F.col("bits").cast("double")) + F.col("motion") / 50).alias("psnr"))
    return C.bd_rate(points)


@query()
def bd_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.when(F.col("idx") % 2 == 0, "a").otherwise("b")
    points = views.frame_stats(spark, sf_dir).select((F.col("stream") % 50).alias("key"), curve.alias("curve"), (F.col("bits") / 100).alias("rate"), (30 + F.log(F.col("bits").cast("double")) + F.col("motion") / 50).alias("psnr"))
    return C.bd_rate(points, "psnr")


@query(f"""{SEG} SELECT stream, printf('<?xml version="1.0"?>' || chr(10) || '<MPD type="static" mediaPresentationDuration="PT%.3fS"><Period><AdaptationSet>', sum(duration) / 1000.0) || '<Representation id="a" bandwidth="100" width="16" height="9"><SegmentList>' || string_agg(printf('<SegmentURL media="segment_%05d.m4s" duration="%d"/>', segment, duration), '' ORDER BY segment) || '</SegmentList></Representation></AdaptationSet></Period></MPD>' || chr(10) AS manifest FROM segs GROUP BY stream""")
def dash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dash_manifest(C.segments(views.packets(spark, sf_dir), 21_600_000, 86_400_000), [("a", 100, 16, 9)])


@query(f"{ST} SELECT stream, idx, kind, bits, complexity, motion FROM stats")
def pass_statistics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read_statistics_json(D.statistics_json(views.frame_stats(spark, sf_dir)))


@query(f"WITH {views.STATS}, u AS (SELECT stream, idx, CAST(trunc(sum(motion - 25) OVER (PARTITION BY stream ORDER BY idx) / 30.0::DOUBLE) AS BIGINT) AS w FROM stats) SELECT stream, idx AS i, w - coalesce(lag(w) OVER (PARTITION BY stream ORDER BY idx), 0) AS correction FROM u")
def drift_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drift_correction(views.frame_stats(spark, sf_dir).select("stream", F.col("idx").alias("i"), (F.col("motion") - 25).alias("drift")), 30.0)


