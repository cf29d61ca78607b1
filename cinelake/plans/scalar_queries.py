"""Queries of the scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import views
from .registration import query


@query("SELECT p_partkey, p_size // gcd(p_size, 60) AS num, 60 // gcd(p_size, 60) AS den FROM part")
def rational_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.rational(F.col("p_size"), F.lit(60))
    return views.table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.num", "r.den")


def _pair() -> tuple:
    return S.rational(F.col("p_size"), F.lit(60)), S.rational(F.col("p_partkey") % 7 + 1, F.lit(24))


_ARITH = """WITH v AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS a, 60 AS b, p_partkey % 7 + 1 AS c, 24 AS d FROM part),
w AS (SELECT p_partkey, a*d + c*b AS an, b*d AS ad, a*d - c*b AS sn, b*d AS sd, a*c AS mn, b*d AS md, a*d AS qn, b*c AS qd FROM v)
SELECT p_partkey, an // gcd(an, ad) AS add_num, ad // gcd(an, ad) AS add_den, CASE WHEN sn < 0 THEN -(-sn // gcd(sn, sd)) ELSE sn // gcd(sn, sd) END AS sub_num, sd // gcd(sn, sd) AS sub_den,
 mn // gcd(mn, md) AS mul_num, md // gcd(mn, md) AS mul_den, qn // gcd(qn, qd) AS div_num, qd // gcd(qn, qd) AS div_den FROM w"""


@query(_ARITH)
def rational_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair()
    ops = {"add": S.rational_add, "sub": S.rational_sub, "mul": S.rational_mul, "div": S.rational_div}
    rows = views.table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    rows = rows.select("p_partkey", *[f(F.col("a"), F.col("b")).alias(name) for name, f in ops.items()])
    return rows.select("p_partkey", *[F.col(f"{name}.{part}").alias(f"{name}_{part}") for name in ops for part in ("num", "den")])


@query("SELECT p_partkey, n // gcd(n, 1000000) AS num, 1000000 // gcd(n, 1000000) AS den FROM (SELECT p_partkey, CAST(round(p_retailprice / 16 * 1000000) AS BIGINT) AS n FROM part)")
def rational_of_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.rational_from_float(F.col("p_retailprice") / 16)
    return views.table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.num", "r.den")


@query(f"WITH {views.PACKETS} SELECT event_id, round(coalesce(pts * 1 / 90000.0::DOUBLE, 0), 6) AS seconds, CAST(round((size / 100.0::DOUBLE) * 90000) AS BIGINT) AS ticks, CAST(trunc(CAST(pts AS HUGEINT) * 90000 // 1001) AS BIGINT) AS rescaled FROM packets")
def timestamp_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    return views.packets(spark, sf_dir).select(
        "event_id",
        F.round(S.to_seconds(F.col("pts"), one, F.lit(90000)), 6).alias("seconds"),
        S.from_seconds(F.col("size") / 100, one, F.lit(90000)).alias("ticks"),
        S.rescale(F.col("pts"), one, F.lit(1001), one, F.lit(90000)).alias("rescaled"),
    )


_DF = """WITH v AS (SELECT event_id, event_id * 37 AS n FROM events), w AS (SELECT event_id, n, n + 18 * (n // 17982) + CASE WHEN n % 17982 >= 1800 THEN 2 * ((n % 17982 - 1800) // 1798 + 1) ELSE 0 END AS l FROM v)
SELECT event_id, printf('%02d:%02d:%02d:%02d', n // 90000, n // 1500 % 60, n // 25 % 60, n % 25) AS plain, printf('%02d:%02d:%02d;%02d', l // 108000, l // 1800 % 60, l // 30 % 60, l % 30) AS dropped, n AS back FROM w"""


@query(_DF)
def smpte_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 37
    rows = views.table(spark, sf_dir, "events").select("event_id", S.smpte_from_frames(n, 25).alias("plain"), S.smpte_from_frames(n, 30, drop=True).alias("dropped"))
    return rows.withColumn("back", S.smpte_to_frames(F.col("dropped"), 30, drop=True))


@query("SELECT event_id, greatest(event_id * 37 - 5000, 0) AS frames FROM events")
def smpte_add_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = S.smpte_from_frames(F.col("event_id") * 37, 25)
    return views.table(spark, sf_dir, "events").select("event_id", F.greatest(S.smpte_to_frames(code, 25) - 5000, F.lit(0)).cast("long").alias("frames"))


@query(f"WITH {views.CUES} SELECT track, ordinal, start_ms, end_ms, start_ms // 10 * 10 AS ass_ms FROM cues")
def cue_time_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.col("start_ms"), F.col("end_ms")
    return views.cues(spark, sf_dir).select("track", "ordinal", S.cue_time(S.clock(start)).alias("start_ms"), S.cue_time(S.clock(end, ".", short=True)).alias("end_ms"), S.ass_time(S.ass_clock(start)).alias("ass_ms"))


@query("SELECT p_partkey, p_size * (CASE p_partkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 ELSE 1 END)::BIGINT AS bits FROM part")
def bitrate_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("k", "M", "G", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", S.bitrate(F.concat(F.col("p_size").cast("string"), unit)).alias("bits"))


@query("SELECT p_partkey, CAST(p_size * 16 AS INTEGER) AS width, CAST(p_partkey % 1080 AS INTEGER) AS height FROM part")
def resolution_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("p_size") * 16).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(":"), (F.col("p_partkey") % 1080).cast("string"))
    return views.table(spark, sf_dir, "part").select("p_partkey", S.resolution(text).alias("r")).select("p_partkey", "r.width", "r.height")


@query("""SELECT p_partkey, CASE WHEN abs(r - 4.0/3) < 0.01 THEN '4:3' WHEN abs(r - 16.0/9) < 0.01 THEN '16:9' WHEN abs(r - 2.35) < 0.01 THEN '47:20' WHEN abs(r - 1) < 0.01 THEN '1:1'
 ELSE concat(CAST(floor(r * 1000) AS BIGINT) // gcd(CAST(floor(r * 1000) AS BIGINT), 1000), ':', 1000 // gcd(CAST(floor(r * 1000) AS BIGINT), 1000)) END AS aspect FROM (SELECT p_partkey, p_size::DOUBLE / 16 AS r FROM part)""")
def aspect_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", S.aspect_ratio(F.col("p_size") / 16).alias("aspect"))


@query("SELECT p_partkey, round(pow(10.0, (p_size - 60) / 20.0), 6) AS gain, round(20 * log10(p_size / 50.0), 6) AS db, round(pow(2.0, 1 - (least(greatest(p_size, 1), 8) - 1) / 3.5), 6) AS scale FROM part")
def decibel_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return views.table(spark, sf_dir, "part").select("p_partkey", F.round(S.db_to_linear(size - 60.0), 6).alias("gain"), F.round(S.linear_to_db(size / 50.0), 6).alias("db"), F.round(S.qp_scale(size), 6).alias("scale"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'mp4' WHEN 1 THEN 'matroska' WHEN 2 THEN 'mpegts' WHEN 3 THEN 'y4m' END AS format FROM part")
def format_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("M4V", "mka", "m2ts", "yuv", "txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", S.format_of(F.concat(F.lit("/media/a.b/"), F.col("p_name"), F.lit("."), ext)).alias("format"))


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'wav' WHEN 2 THEN 'flac' ELSE 'unknown' END AS format, count(*) AS n FROM part GROUP BY 1")
def format_by_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ("0000001866747970", "524946460000000057415645", "664C6143", "00112233")
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 4 + 1).cast("int")))
    return views.table(spark, sf_dir, "part").groupBy(S.magic_format(head).alias("format")).agg(F.count("*").alias("n"))
