"""Queries over cues: readers, writers and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import documents as D
from ..operators.islands import interval_join
from ..sources import subtitles
from . import views
from .registration import query

CU = f"WITH {views.CUES}"


def _clock(ms: str, comma: str) -> str:
    return f"printf('%02d:%02d:%02d{comma}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _short(ms: str) -> str:
    return f"CASE WHEN {ms} < 3600000 THEN printf('%02d:%02d.%03d', {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000) ELSE {_clock(ms, '.')} END"


@query(f"{CU}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ordinal) AS n FROM cues) SELECT track, string_agg(n || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS body FROM n GROUP BY track")
def srt_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.srt_track(views.cues(spark, sf_dir))


@query(f"{CU} SELECT track, 'WEBVTT' || chr(10) || chr(10) || string_agg({_short('start_ms')} || ' --> ' || {_short('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS body FROM cues GROUP BY track")
def vtt_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vtt_track(views.cues(spark, sf_dir))


_CODE = lambda ms: f"printf('%02d:%02d:%02d:%02d', ({ms} // 40) // 90000, ({ms} // 40) // 1500 % 60, ({ms} // 40) // 25 % 60, ({ms} // 40) % 25)"


@query(f"{CU}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ordinal) AS n FROM cues) SELECT track, 'TITLE: cues' || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10) || string_agg(printf('%03d  %-8s V     C        ', n, role) || {_CODE('start_ms')} || ' ' || {_CODE('end_ms')} || ' ' || {_CODE('start_ms')} || ' ' || {_CODE('end_ms')}, chr(10) ORDER BY ordinal) || chr(10) AS body FROM n GROUP BY track")
def edl_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edl(views.cues(spark, sf_dir).withColumnRenamed("role", "reel"), "cues")


@query(f"{CU} SELECT track, start_ms, end_ms, replace(text, chr(10) || chr(10), chr(10)) AS text FROM cues")
def srt_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = views.cues(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n\n", "\n"))
    return subtitles.parse_srt(C.srt_track(flat), "track", "body").select("track", "start_ms", "end_ms", "text")


@query(f"{CU} SELECT track, start_ms, end_ms, replace(text, chr(10) || chr(10), chr(10)) AS text FROM cues")
def vtt_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = views.cues(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n\n", "\n"))
    return subtitles.parse_vtt(C.vtt_track(flat), "track", "body").select("track", "start_ms", "end_ms", "text")


_POINTS = "points AS (SELECT track, ordinal * 7000 AS t FROM cues)"


@query(f"{CU}, {_POINTS} SELECT p.track, p.t, c.ordinal FROM points p JOIN cues c ON c.track = p.track AND p.t >= c.start_ms AND p.t < c.end_ms")
def cue_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = views.cues(spark, sf_dir)
    points = cues.select("track", (F.col("ordinal") * 7000).alias("t"))
    return interval_join(points, cues, "track", "t", "start_ms", "end_ms", 60_000).select("track", "t", "ordinal")


@query(f"{CU}, {_POINTS}, r AS (SELECT p.track, p.t, c.ordinal, row_number() OVER (PARTITION BY p.track, p.t ORDER BY c.ordinal) AS k FROM points p JOIN cues c ON c.track = p.track AND p.t BETWEEN c.start_ms AND c.end_ms) SELECT track, t, ordinal FROM r WHERE k = 1")
def cue_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = views.cues(spark, sf_dir)
    points = cues.select("track", (F.col("ordinal") * 7000).alias("t"))
    found = interval_join(points, cues, "track", "t", "start_ms", "end_ms", 60_000, closed=True)
    return found.groupBy("track", "t").agg(F.min("ordinal").alias("ordinal"))


@query(f"{CU} SELECT track, coalesce(max(end_ms), 0) AS duration FROM cues GROUP BY track")
def timeline_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cues(spark, sf_dir).groupBy("track").agg(F.coalesce(F.max("end_ms"), F.lit(0)).alias("duration"))


@query(f"{CU} SELECT track, ordinal, start_ms, lead(start_ms) OVER (PARTITION BY track ORDER BY start_ms, ordinal) AS end_ms FROM cues")
def chapter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("track").orderBy("start_ms", "ordinal")
    return views.cues(spark, sf_dir).select("track", "ordinal", "start_ms", F.lead("start_ms").over(order).alias("end_ms"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _ass(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000 // 10)"


@query(f"{CU} SELECT track, '{D.ASS_HEAD}' || string_agg('Dialogue: 0,' || {_ass('start_ms')} || ',' || {_ass('end_ms')} || ',Default,' || replace(text, chr(10), '\\N'), chr(10) ORDER BY ordinal) || chr(10) AS body FROM cues GROUP BY track")
def ass_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ass_track(views.cues(spark, sf_dir))


@query(f"{CU} SELECT track, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, 'Default' AS style, replace(text, chr(10), '\\N') AS text FROM cues")
def ass_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.parse_ass(D.ass_track(views.cues(spark, sf_dir)), "track", "body").drop("ordinal")


@query(f"""{CU} SELECT track, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xmeml version="5"><sequence><name>cues</name><rate><timebase>25</timebase></rate><media><video><track>' || chr(10) || string_agg('<clipitem><name>' || role || '</name><start>' || start_ms // 40 || '</start><end>' || end_ms // 40 || '</end></clipitem>', chr(10) ORDER BY ordinal) || chr(10) || '</track></video></media></sequence></xmeml>' || chr(10) AS body FROM cues GROUP BY track""")
def xml_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.xml_timeline(views.cues(spark, sf_dir).withColumnRenamed("role", "reel"), "cues")


@query("SELECT o_orderkey, 'in ' || o_orderkey || '.mov' AS input, 'out' || o_orderkey || '.mp4' AS output, CASE WHEN o_orderkey % 2 = 0 THEN 'h264' ELSE 'copy' END AS video_codec, o_orderkey % 60 AS start, CASE WHEN o_orderkey % 3 = 0 THEN '-odd' ELSE '' END AS extra, CASE o_orderkey % 3 WHEN 1 THEN 90.5 WHEN 2 THEN 200.0 - o_orderkey % 60 END::DOUBLE AS seconds FROM orders")
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcode jobs that are read from command lines made of the orders."""
    key = F.col("o_orderkey")
    cut = F.when(key % 3 == 1, " -t 1:30.5").when(key % 3 == 2, " -to 3:20").otherwise(" -odd")
    codec = F.when(key % 2 == 0, " -c:v h264").otherwise(" -c copy")
    line = F.concat(F.lit("ffmpeg -y -ss "), (key % 60).cast("string"), F.lit(" -i 'in "), key.cast("string"), F.lit(".mov'"), codec, cut, F.lit(" out"), key.cast("string"), F.lit(".mp4"))
    made = views.table(spark, sf_dir, "orders").select("o_orderkey", D.parse_commands(line).alias("j"))
    return made.select("o_orderkey", F.array_join("j.inputs", ",").alias("input"), "j.output", F.col("j.params")["video_codec"].alias("video_codec"), F.col("j.params")["start"].cast("long").alias("start"), F.array_join("j.extra", ",").alias("extra"), "j.seconds")
