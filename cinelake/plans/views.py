"""Stand-ins for media records over the driver's tables, as DataFrames and as SQL.

``samples``: signed 16-bit audio, a stream per user; ``packets``: a stream per user with millisecond times;
``frames``: 8x8 luma planes; ``frame_stats``: an encoder's statistics, a stream per order; ``cues``: a subtitle track
per conversation; ``jobs`` and ``workers``: the transcode queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("stream").orderBy("ts", "event_id")
    x = F.least(F.round(F.col("value") * 100).cast("int") - 5000, F.lit(32767))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "ts", "event_id", x.alias("x"))
    return rows.select("stream", (F.row_number().over(order) - 1).cast("long").alias("i"), "x")


SAMPLES = "samples AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(CAST(round(value * 100) AS INTEGER) - 5000, 32767) AS x FROM events)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("stream").orderBy("pts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("pts"),
        "event_id",
        F.round(F.col("value") * 100).cast("long").alias("size"),
        (F.col("event_type") == "signup").alias("keyframe"),
        F.col("event_type").alias("kind"),
    )
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


PACKETS = "packets AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pts, event_id) - 1 AS seq FROM (SELECT user_id AS stream, epoch_us(ts) // 1000 AS pts, event_id, CAST(round(value * 100) AS BIGINT) AS size, event_type = 'signup' AS keyframe, event_type AS kind FROM events))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + x.cast("double") * 128).cast("int"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), plane.alias("p"), "label")


FRAMES = "frames AS (SELECT vec_id AS frame_no, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(128.0::DOUBLE + x::DOUBLE * 128) AS INTEGER)))) AS p, label FROM embeddings)"
PIXELS = FRAMES + ", pixels AS (SELECT frame_no, unnest(p) AS v, unnest(range(len(p))) AS k FROM frames)"


def to_binary(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def _frames_of(spark: SparkSession, sf_dir: str, width: int, height: int, data: Column) -> DataFrame:
    """Whole frames in seven streams."""
    rows = frames(spark, sf_dir)
    return rows.select((F.col("frame_no") % 7).alias("stream"), F.expr("frame_no div 7").alias("frame_no"), F.lit(width).alias("width"), F.lit(height).alias("height"), to_binary(data).alias("data"))


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB frames of 5x4 pixels."""
    return _frames_of(spark, sf_dir, 5, 4, F.slice("p", 1, 60))


RGB = FRAMES + ", rgb AS (SELECT frame_no % 7 AS stream, frame_no // 7 AS frame_no, p[1:60] AS d FROM frames)"


def yuv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YUV420P frames of 8x8 pixels."""
    return _frames_of(spark, sf_dir, 8, 8, F.concat(F.col("p"), F.slice("p", 1, 32)))


YUV = FRAMES + ", yuv AS (SELECT frame_no % 7 AS stream, frame_no // 7 AS frame_no, list_concat(p, p[1:32]) AS d FROM frames)"


def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YUV420P frames of 16x16 pixels."""
    return _frames_of(spark, sf_dir, 16, 16, F.concat(*[F.col("p")] * 6))


WIDE = FRAMES + ", wide AS (SELECT frame_no % 7 AS stream, frame_no // 7 AS frame_no, flatten([p, p, p, p, p, p]) AS d FROM frames)"


#: What orders the frames of a stream.
FRAME_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of ``frame_stats`` with the columns that order them, not yet numbered."""
    kind = F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "N", "P").otherwise("B")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream"),
        *FRAME_ORDER,
        kind.alias("kind"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bits"),
        F.round(F.col("l_discount") * 100).cast("long").alias("complexity"),
        F.round(F.col("l_quantity")).cast("long").alias("motion"),
    )


def frame_index() -> Column:
    """The number of a frame of ``frame_lines``.  Windows in the same order share its sort, which those by the number can't."""
    return F.row_number().over(W.partitionBy("stream").orderBy(*FRAME_ORDER)).cast("long").alias("idx")


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_lines(spark, sf_dir).select("stream", frame_index(), "kind", "bits", "complexity", "motion")


STATS = "stats AS (SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS idx, CASE l_returnflag WHEN 'A' THEN 'I' WHEN 'N' THEN 'P' ELSE 'B' END AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS bits, CAST(round(l_discount * 100) AS BIGINT) AS complexity, CAST(round(l_quantity) AS BIGINT) AS motion FROM lineitem)"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = W.partitionBy("track").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("ordinal"), "role", "text", (F.char_length("text") * 50).cast("long").alias("ms"))
    start = F.coalesce(F.sum("ms").over(before), F.lit(0))
    return rows.select("track", "ordinal", "role", "text", start.alias("start_ms"), (start + F.col("ms")).alias("end_ms"))


CUES = "cues AS (SELECT track, ordinal, role, text, CAST(coalesce(sum(ms) OVER w, 0) AS BIGINT) AS start_ms, CAST(coalesce(sum(ms) OVER w, 0) + ms AS BIGINT) AS end_ms FROM (SELECT conv_id AS track, turn AS ordinal, role, text, CAST(length(text) * 50 AS BIGINT) AS ms FROM conversations) WINDOW w AS (PARTITION BY track ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created"),
        state.alias("state"),
        F.pmod(F.col("o_custkey"), F.lit(8)).cast("int").alias("codec"),
        F.round(F.col("o_totalprice")).cast("long").alias("bytes"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit("gpu")).alias("hw"),
        F.pmod("o_orderkey", F.lit(977)).cast("long").alias("ms"),
    )


JOBS = "jobs AS (SELECT o_orderkey AS job_id, 5 - CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, epoch_us(o_orderdate) // 1000 AS created, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'running' END AS state, CAST(o_custkey % 8 AS INTEGER) AS codec, CAST(round(o_totalprice) AS BIGINT) AS bytes, CASE o_orderkey % 3 WHEN 0 THEN 'gpu' END AS hw, CAST(o_orderkey % 977 AS BIGINT) AS ms FROM orders)"


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("worker_id"),
        (n % 8).cast("int").alias("codec_a"),
        ((n + 3) % 8).cast("int").alias("codec_b"),
        F.array((n % 8).cast("int"), ((n + 3) % 8).cast("int")).alias("codecs"),
        F.when(n % 2 == 0, F.array(F.lit("gpu"))).otherwise(F.array().cast("array<string>")).alias("hws"),
        F.when(n % 5 == 0, "offline").when(n % 5 == 1, "busy").otherwise("ready").alias("state"),
        (n % 4).cast("int").alias("running"),
        F.lit(3).alias("most"),
        (F.round(F.col("s_acctbal")).cast("long") % 60).alias("beat_age"),
    )


WORKERS = "workers AS (SELECT s_suppkey AS worker_id, s_nationkey % 8 AS codec_a, (s_nationkey + 3) % 8 AS codec_b, [s_nationkey % 8, (s_nationkey + 3) % 8] AS codecs, CASE WHEN s_nationkey % 2 = 0 THEN ['gpu'] ELSE [] END AS hws, CASE s_nationkey % 5 WHEN 0 THEN 'offline' WHEN 1 THEN 'busy' ELSE 'ready' END AS state, s_nationkey % 4 AS running, 3 AS most, CAST(round(s_acctbal) AS BIGINT) % 60 AS beat_age FROM supplier)"
