"""Queries that describe streams and formats, and selections over hashes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog as K
from ..operators import pixels as P
from . import views
from .frame_queries import PX, _frames
from .registration import query

_FORMATS = ", ".join(f"('{n}', '{e}')" for n, exts in S.FORMATS.items() for e in exts)


#: The extensions of the parts' files, and one that names no format.
_EXTENSIONS = [*[e for exts in S.FORMATS.values() for e in exts], "txt"]


@query(f"WITH t(name, ext) AS (VALUES {_FORMATS}), files AS (SELECT {_EXTENSIONS}[p_partkey % {len(_EXTENSIONS)} + 1] AS ext FROM part) SELECT name, count(*) AS files, count(DISTINCT ext) AS extensions, string_agg(DISTINCT ext, ',' ORDER BY ext) AS listed FROM files LEFT JOIN t USING (ext) GROUP BY name")
def format_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' files by the format that their extensions name."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % len(_EXTENSIONS) + 1).cast("int"))
    files = views.table(spark, sf_dir, "part").select(ext.alias("ext"), S.format_of(F.concat(F.lit("clip."), ext)).alias("name"))
    return files.groupBy("name").agg(F.count("*").alias("files"), F.countDistinct("ext").alias("extensions"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("listed"))


@query(f"WITH {views.PACKETS}, s AS (SELECT stream, max(pts) - min(pts) AS d, CAST(sum(size) AS BIGINT) AS b FROM packets GROUP BY 1) SELECT count(*) AS streams, max(d) AS duration, CAST(sum(b) AS BIGINT) AS size, CAST(sum(b) * 8000 // max(d) AS BIGINT) AS bit_rate FROM s")
def probe_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = views.packets(spark, sf_dir).groupBy("stream").agg((F.max("pts") - F.min("pts")).alias("d"), F.sum("size").alias("b"))
    return per.agg(F.count("*").alias("streams"), F.max("d").alias("duration"), F.sum("b").alias("size"), F.expr("sum(b) * 8000 div max(d)").alias("bit_rate"))


@query(f"WITH {views.PACKETS}, s AS (SELECT stream, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM packets GROUP BY 1) SELECT stream, '{{\"stream\":' || stream || ',\"packets\":' || n || ',\"size\":' || size || '}}' AS document FROM s")
def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = views.packets(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("packets"), F.sum("size").alias("size"))
    return per.select("stream", F.to_json(F.struct("stream", "packets", "size")).alias("document"))


_HASHES = f"{PX}, m AS (SELECT frame_no, sum(v) AS s FROM pixels GROUP BY 1)"


@query(f"{_HASHES}, n AS (SELECT count(*) AS n FROM m) SELECT frame_no FROM m, n WHERE frame_no % greatest(1, n // 16) = 0 AND frame_no // greatest(1, n // 16) < 16")
def fingerprint_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir)
    n = rows.agg(F.greatest(F.lit(1), F.expr("count(*) div 16")).alias("_n"))  # a single row
    return rows.crossJoin(F.broadcast(n)).filter("frame_no % _n = 0 AND frame_no div _n < 16").select("frame_no")


@query(f"{_HASHES}, o AS (SELECT s, count(*) OVER () AS n, row_number() OVER (ORDER BY s) - 1 AS k FROM m), d AS (SELECT max(s) AS med FROM o WHERE k = n // 2) SELECT min_by(frame_no, abs(s - med) * 1000000 + frame_no) AS frame_no FROM m, d")
def representative_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _frames(spark, sf_dir).select("frame_no", P.total("p").alias("s"))
    median = sums.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY s)").alias("low"), F.count("*").alias("n"))
    # the upper median: of an even number of rows, the least value above or at half of the rows
    upper = sums.groupBy("s").agg(F.count("*").alias("c")).crossJoin(F.broadcast(median)).filter(F.col("s") >= F.col("low"))
    upper = upper.agg(F.min_by("s", "s").alias("first"), F.min(F.when(F.col("s") > F.col("low"), F.col("s"))).alias("second"), F.max("n").alias("n"), F.max("low").alias("low"))
    below = sums.crossJoin(F.broadcast(upper)).agg(F.sum((F.col("s") <= F.col("low")).cast("long")).alias("at"), F.max("n").alias("n"), F.max("first").alias("first"), F.max("second").alias("second"))
    chosen = below.select(F.when(F.col("at") > F.expr("n div 2"), F.col("first")).otherwise(F.coalesce("second", "first")).alias("med"))
    return sums.crossJoin(F.broadcast(chosen)).agg(F.min_by("frame_no", F.abs(F.col("s") - F.col("med")) * 1000000 + F.col("frame_no")).alias("frame_no"))


@query(f"{PX}, s AS (SELECT frame_no, sum(v * v) * 64 - sum(v) * sum(v) AS q, label FROM pixels JOIN frames USING (frame_no) GROUP BY frame_no, label), r AS (SELECT label, frame_no, row_number() OVER (PARTITION BY label ORDER BY q DESC, frame_no DESC) AS k FROM s) SELECT label, frame_no FROM r WHERE k = 1")
def best_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = P.total("p", lambda x: x * x) * F.size("p") - P.total("p") * P.total("p")
    return views.frames(spark, sf_dir).groupBy("label").agg(F.max_by("frame_no", F.struct(score, F.col("frame_no"))).alias("frame_no"))


@query(f"WITH {views.STATS}, k AS (SELECT stream, idx, bits, row_number() OVER (PARTITION BY stream ORDER BY complexity DESC, idx) AS r, complexity FROM stats) SELECT stream, idx FROM k WHERE complexity >= 8 OR r <= 2")
def adaptive_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("stream").orderBy(F.col("complexity").desc(), "idx")
    return views.frame_stats(spark, sf_dir).withColumn("_r", F.row_number().over(order)).filter("complexity >= 8 OR _r <= 2").select("stream", "idx")


@query("SELECT p_partkey, CAST(p_size * 40 * 9 // 16 // 2 * 2 AS INTEGER) AS height, CAST(p_size * 40 * (p_size * 40 * 9 // 16 // 2 * 2) * 30 * 0.1 AS BIGINT) AS bits FROM part")
def proxy_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.expr("p_size * 40 * 9 div 16 div 2 * 2")
    return views.table(spark, sf_dir, "part").select("p_partkey", height.cast("int").alias("height"), F.round(F.col("p_size") * 40 * height * 30 * 0.1).cast("long").alias("bits"))


@query(f"WITH {views.STATS} SELECT stream, round(CASE WHEN var_pop(motion) > 0.01 THEN log2(sqrt(var_pop(motion))) + 1 + 0.5 * log2(2 * pi() * exp(1)) ELSE 0.5 END, 6) AS bits FROM stats GROUP BY stream")
def bits_per_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frame_stats(spark, sf_dir).groupBy("stream").agg(F.round(K.bits_per_element(F.col("motion")), 6).alias("bits"))
