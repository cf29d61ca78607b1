"""Queries of the pixel operators over the frames stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import motion as M
from ..operators import pixels as P
from . import views
from .registration import query

FR = f"WITH {views.FRAMES}"
PX = f"WITH {views.PIXELS}"
#: Each pixel with the one of the frame before.
PREV = f"{PX}, both_px AS (SELECT b.frame_no, b.k, b.v AS v, a.v AS w FROM pixels b JOIN (SELECT frame_no, lag(frame_no) OVER (ORDER BY frame_no) AS before FROM frames) n ON n.frame_no = b.frame_no JOIN pixels a ON a.frame_no = n.before AND a.k = b.k)"


def sql_map(source: str) -> str:
    """Rebuild planes: ``source`` is the old place of the pixel at ``k``."""
    return f"{FR} SELECT frame_no, [p[({source}) + 1] for k in range(64)] AS p FROM frames"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("frame_no", "p")


def _text(df: DataFrame) -> DataFrame:
    """Planes as text, for comparison by value."""
    return df.select("frame_no", F.array_join(F.transform("p", lambda v: v.cast("string")), ",").alias("plane"))


def _sql_text(body: str) -> str:
    return f"SELECT frame_no, array_to_string(p, ',') AS plane FROM ({body})"


@query(_sql_text(f"{FR} SELECT frame_no, list_transform(p, lambda v: CAST(floor(greatest(0, least(255, (v - 128) * 1.5::DOUBLE + 128 + 10))) AS INTEGER)) AS p FROM frames"))
def brightness_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(P.brightness_contrast(_frames(spark, sf_dir), 10, 1.5))


@query(_sql_text(f"{FR} SELECT frame_no, [p[(k // 4 + 3) * 8 + k % 4 + 2 + 1] for k in range(16)] AS p FROM frames"))
def crop_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(P.crop(_frames(spark, sf_dir), 8, 2, 3, 4, 4))


@query(_sql_text(sql_map("(7 - k % 8) * 8 + k // 8")))
def rotate_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(P.rotate(_frames(spark, sf_dir), 8, 8, 450))


@query(_sql_text(sql_map("k // 8 * 8 + 7 - k % 8")))
def flip_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(P.flip(_frames(spark, sf_dir), 8, 8))


@query(f"{FR} SELECT frame_no, array_to_string([v * 1023 // 255 for v in p], ',') AS ten, array_to_string([(v * 1023 // 255) * 255 // 1023 for v in p], ',') AS plane FROM frames")
def bit_depth_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).select("frame_no", P.to_ten_bits(F.col("p")).alias("t"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return rows.select("frame_no", text(F.col("t")).alias("ten"), text(P.to_eight_bits(F.col("t"))).alias("plane"))


@query(f"{PX}, l AS (SELECT [0.0, 64.0, 96.0, 192.0, 255.0] AS t) SELECT frame_no, round(sum(t[CAST(floor(v * 4 / 255.0) AS INTEGER) + 1] + (t[least(CAST(floor(v * 4 / 255.0) AS INTEGER) + 1, 4) + 1] - t[CAST(floor(v * 4 / 255.0) AS INTEGER) + 1])::DOUBLE * (v * 4 / 255.0::DOUBLE - floor(v * 4 / 255.0))), 4) AS total FROM pixels, l GROUP BY frame_no")
def one_dimensional_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).select("frame_no", P.one_dimensional_lut(F.col("p"), [0.0, 64.0, 96.0, 192.0, 255.0]).alias("p"))
    return rows.select("frame_no", F.round(P.total("p", kind="double"), 4).alias("total"))


@query(f"{PREV} SELECT frame_no, round(sum((v - w) * (v - w)) / 64.0, 6) AS mse, round(CASE WHEN sum((v - w) * (v - w)) = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0 / (sum((v - w) * (v - w)) / 64.0)) END, 6) AS psnr FROM both_px GROUP BY 1")
def mse_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL")
    return rows.select("frame_no", F.round(P.mse(), 6).alias("mse"), F.round(P.psnr(P.mse()), 6).alias("psnr"))


_SSIM = f"""{PREV}, s AS (SELECT frame_no, avg(v::DOUBLE) AS a, avg(w::DOUBLE) AS b, sum(v * v) / 64.0::DOUBLE AS aa, sum(w * w) / 64.0::DOUBLE AS bb, sum(v * w) / 64.0::DOUBLE AS ab FROM both_px GROUP BY 1)
SELECT frame_no, round(greatest(0, least(1, (2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)))), 6) AS ssim FROM s"""


@query(_SSIM)
def ssim_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL")
    return rows.select("frame_no", F.round(P.ssim_block(), 6).alias("ssim"))


@query(f"""SELECT CASE WHEN psnr >= 45 AND ssim >= 0.98 THEN 'excellent' WHEN psnr >= 38 AND ssim >= 0.95 THEN 'good' WHEN psnr >= 32 AND ssim >= 0.9 THEN 'fair' WHEN psnr >= 25 AND ssim >= 0.8 THEN 'poor' ELSE 'bad' END AS rating, count(*) AS n FROM (
 SELECT 20 + frame_no % 30 AS psnr, 0.75 + (frame_no % 25) / 100.0 AS ssim FROM ({FR} SELECT frame_no FROM frames)) GROUP BY 1""")
def quality_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    psnr, ssim = 20 + F.col("frame_no") % 30, F.round(0.75 + (F.col("frame_no") % 25) / 100.0, 6)
    return _frames(spark, sf_dir).groupBy(P.quality_rating(psnr, ssim).alias("rating")).agg(F.count("*").alias("n"))


@query(f"{PX} SELECT CAST(v AS INTEGER) AS bin, count(*) AS n FROM pixels GROUP BY 1")
def luma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(_frames(spark, sf_dir))


@query(f"{PX}, c AS (SELECT frame_no, v, count(*) AS n FROM pixels GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY n DESC, v DESC) AS k FROM c) SELECT frame_no, CAST(v AS INTEGER) AS peak, n FROM r WHERE k = 1")
def histogram_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram_peak(_frames(spark, sf_dir))


@query(f"{PX} SELECT CAST(k % 8 AS INTEGER) AS \"column\", v AS luma, count(*) AS n FROM pixels GROUP BY 1, 2")
def waveform_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.waveform(_frames(spark, sf_dir), 8)


@query(f"{PX} SELECT CAST(k * 3 // 64 AS INTEGER) AS section, v AS bin, count(*) AS n FROM pixels GROUP BY 1, 2")
def rgb_parade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parade(_frames(spark, sf_dir), 3)


@query(f"{PREV} SELECT v AS u, w AS v, count(*) AS n FROM both_px GROUP BY 1, 2")
def vectorscope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL")
    return P.vectorscope(rows.select(F.col("p").alias("u"), F.col("q").alias("v")))


@query(f"{PREV} SELECT round(100.0 * sum(((v - 128) * (v - 128) + (w - 128) * (w - 128) <= 13924)::INTEGER) / count(*), 6) AS percent FROM both_px")
def broadcast_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL")
    scope = P.vectorscope(rows.select(F.col("p").alias("u"), F.col("q").alias("v")))
    return P.broadcast_safe(scope).select(F.round("percent", 6).alias("percent"))


@query(f"{PX} SELECT frame_no, round(avg((v < 120)::INTEGER), 6) AS dark, avg((v < 120)::INTEGER) >= 0.3 AS black, round(avg(v) / 255, 6) AS luma FROM pixels GROUP BY 1")
def black_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", F.round(P.dark_share("p", 120), 6).alias("dark"), P.is_black("p", 120, 0.3).alias("black"), F.round(P.average_luma("p"), 6).alias("luma"))


@query(f"{PX}, l AS (SELECT frame_no, avg(v) / 255 AS l FROM pixels GROUP BY 1), w AS (SELECT frame_no, l, lead(l, 4) OVER (ORDER BY frame_no) AS m FROM l) SELECT frame_no AS start, frame_no + 5 AS stop FROM w WHERE l > 0.505 AND m < 0.495")
def fade_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = _frames(spark, sf_dir).select("frame_no", P.average_luma("p").alias("l"))
    later = luma.select((F.col("frame_no") - 4).alias("frame_no"), F.col("l").alias("m"))
    return luma.join(later, "frame_no").filter("l > 0.505 AND m < 0.495").select(F.col("frame_no").alias("start"), (F.col("frame_no") + 5).alias("stop"))


_CHI = f"""{PREV}, h AS (SELECT frame_no, v // 16 AS b, 1 AS x, 0 AS y FROM both_px UNION ALL SELECT frame_no, w // 16, 0, 1 FROM both_px), c AS (SELECT frame_no, b, sum(x) AS x, sum(y) AS y FROM h GROUP BY 1, 2)
SELECT frame_no, round(sum((x - y) * (x - y) / (x + y)) / 2, 6) AS distance, sum((x - y) * (x - y) / (x + y)) / 2 > 12.0001 AS scene FROM c GROUP BY 1"""


@query(_CHI)
def scene_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.chi_square(P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL"), 16)
    return rows.select("frame_no", F.round("distance", 6).alias("distance"), (F.col("distance") > 12.0001).alias("scene"))


@query(f"{PREV}, s AS (SELECT frame_no, least(1, (sum(v * v) * 64 - sum(v) * sum(v)) / 4096.0 / 65025) AS sc FROM pixels GROUP BY 1), t AS (SELECT frame_no, least(1, sum(abs(v - w)) / (64 * 255.0)) AS tc FROM both_px GROUP BY 1) SELECT frame_no, round(sc, 6) AS spatial, round(coalesce(tc, 0), 6) AS temporal FROM s LEFT JOIN t USING (frame_no)")
def frame_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir))
    return rows.select("frame_no", F.round(P.spatial_complexity("p"), 6).alias("spatial"), F.round(F.when(F.col("q").isNull(), 0.0).otherwise(P.temporal_complexity()), 6).alias("temporal"))


def _sql_bits(flag: str, source: str) -> str:
    return f"SELECT frame_no, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash FROM (SELECT frame_no, sum(CASE WHEN {flag} THEN CAST(1 AS HUGEINT) << (63 - k)::INTEGER ELSE 0 END) AS h FROM {source} GROUP BY 1)"


AHASH = f"{PX}, m AS (SELECT frame_no, sum(v) // 64 AS m FROM pixels GROUP BY 1), src AS (SELECT * FROM pixels JOIN m USING (frame_no)), ahash AS ({_sql_bits('v > m', 'src')})"


@query(f"{AHASH} SELECT * FROM ahash")
def average_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", P.average_hash("p").alias("hash"))


@query(f"{PX}, src AS (SELECT a.frame_no, a.k, a.v, b.v AS r FROM pixels a JOIN pixels b ON a.frame_no = b.frame_no AND b.k = a.k // 8 * 8 + (a.k + 1) % 8) {_sql_bits('v < r', 'src')}")
def difference_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", P.difference_hash("p").alias("hash"))


@query(f"{PX}, m AS (SELECT frame_no, list_sort(p)[33] AS m FROM frames), src AS (SELECT * FROM pixels JOIN m USING (frame_no)) {_sql_bits('v > m', 'src')}")
def median_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", P.median_hash("p").alias("hash"))


@query(f"{AHASH} SELECT a.frame_no, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance, 1 - bit_count(xor(a.hash, b.hash)) / 64.0::DOUBLE AS similarity FROM ahash a JOIN ahash b ON b.frame_no = a.frame_no + 1")
def fingerprint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _frames(spark, sf_dir).select("frame_no", P.average_hash("p").alias("hash"))
    pairs = h.join(h.select((F.col("frame_no") - 1).alias("frame_no"), F.col("hash").alias("other")), "frame_no")
    d = P.hamming(F.col("hash"), F.col("other"))
    return pairs.select("frame_no", d.cast("long").alias("distance"), P.similarity(d).alias("similarity"))


@query(f"{PX} SELECT frame_no, round(log2(count(DISTINCT v)) / 10 * 10, 6) AS bits FROM pixels GROUP BY 1")
def effective_bit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", F.round(P.effective_bit_depth("p"), 6).alias("bits"))


@query(f"{PX} SELECT a.frame_no, round(sum((abs(a.v - b.v) BETWEEN 1 AND 8)::INTEGER) * 100.0 / 63, 6) AS percent FROM pixels a JOIN pixels b ON a.frame_no = b.frame_no AND b.k = a.k + 1 GROUP BY 1")
def banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", F.round(P.banding_percent("p", 8), 6).alias("percent"))


@query(f"{PREV}, b AS (SELECT frame_no, k, CAST(floor(v * 0.75 + w * 0.25) AS INTEGER) AS x FROM both_px) SELECT frame_no, array_to_string(list(x ORDER BY k), ',') AS plane FROM b GROUP BY 1")
def frame_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL")
    return _text(rows.select("frame_no", P.blend("p", "q", 0.25).alias("p")))


@query(f"{PX}, d AS (SELECT frame_no, k, CAST(floor(avg(v) OVER (PARTITION BY k ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS INTEGER) AS x FROM pixels) SELECT frame_no, array_to_string(list(x ORDER BY k), ',') AS plane FROM d GROUP BY 1")
def temporal_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(P.moving_average_denoise(_frames(spark, sf_dir), 3))


@query(f"{PX} SELECT frame_no, array_to_string(list(v ORDER BY k) FILTER (k // 8 % 2 = 0), ',') AS top, array_to_string(list(v ORDER BY k) FILTER (k // 8 % 2 = 1), ',') AS bottom FROM pixels GROUP BY 1")
def interlace_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return P.split_fields(_frames(spark, sf_dir), 8).select("frame_no", text("top"), text("bottom"))


@query(f"{PREV} SELECT frame_no, sum(CASE WHEN (abs(v - 130) + abs(w - 120) + abs(v - 125)) % 256 <= 20 THEN 0 ELSE 1 END)::BIGINT AS kept FROM both_px GROUP BY 1")
def chroma_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL").select("frame_no", "p", "q", F.col("p").alias("r"))
    return rows.select("frame_no", P.total(P.key_mask("p", "q", "r", (130, 120, 125), 20), lambda x: F.when(x == 0, 0).otherwise(1)).alias("kept"))


_BLUR = f"{PX}, b AS (SELECT a.frame_no, a.k, a.v, sum(b.v) AS s, count(*) AS n FROM pixels a JOIN pixels b ON a.frame_no = b.frame_no AND abs(a.k // 8 - b.k // 8) <= 1 AND abs(a.k % 8 - b.k % 8) <= 1 GROUP BY 1, 2, 3) SELECT frame_no, array_to_string(list(CASE WHEN n = 9 THEN s // 9 ELSE v END ORDER BY k), ',') AS plane FROM b GROUP BY 1"


@query(_BLUR)
def feather_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_frames(spark, sf_dir).select("frame_no", P.box_blur("p", 8, 8).alias("p")))


_RGB = "rgb AS (SELECT frame_no, p[1] AS r, p[2] AS g, p[3] AS b FROM frames)"


@query(f"""{FR}, {_RGB}, c AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM rgb) SELECT frame_no, CAST(floor(round(greatest(0, least(255, y)), 9)) AS INTEGER) AS y, CAST(floor(round(greatest(0, least(255, (b - y) / 1.772 + 128)), 9)) AS INTEGER) AS u, CAST(floor(round(greatest(0, least(255, (r - y) / 1.402 + 128)), 9)) AS INTEGER) AS v FROM c""")
def rgb_to_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (P.at("p", F.lit(k)) for k in range(3))
    return _frames(spark, sf_dir).select("frame_no", P.rgb_to_yuv(r, g, b).alias("c")).select("frame_no", "c.*")


@query(f"""{FR}, {_RGB}, m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM rgb), h AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN hi = r THEN 60 * ((g - b)::DOUBLE / d) WHEN hi = g THEN 60 * ((b - r)::DOUBLE / d + 2) ELSE 60 * ((r - g)::DOUBLE / d + 4) END AS h FROM m)
SELECT frame_no, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 6) AS h, round(CASE WHEN hi = 0 THEN 0 ELSE d::DOUBLE / hi END, 6) AS s, round(hi / 255.0, 6) AS v FROM h""")
def rgb_to_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (P.at("p", F.lit(k)) for k in range(3))
    return _frames(spark, sf_dir).select("frame_no", P.rgb_to_hsv(r, g, b).alias("c")).select("frame_no", *[F.round(f"c.{x}", 6).alias(x) for x in "hsv"])


@query(f"""{FR}, a AS (SELECT frame_no, p[1] * p[4] // 255 AS c1, p[4] AS a1, p[2] * p[5] // 255 AS c2, p[5] AS a2 FROM frames) SELECT frame_no, least(c1 + c2 * (255 - a1) // 255, 255) AS color, least(a1 + a2 * (255 - a1) // 255, 255) AS alpha FROM a""")
def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [P.at("p", F.lit(k)) for k in range(5)]
    color, alpha = P.composite_over(P.premultiply(v[0], v[3]), v[3], P.premultiply(v[1], v[4]), v[4])
    return _frames(spark, sf_dir).select("frame_no", color.alias("color"), alpha.alias("alpha"))


_SCORE = f"{PX}, q AS (SELECT frame_no, sum(v * v) * 64 - sum(v) * sum(v) AS c, sum(v) AS s FROM pixels GROUP BY 1)"


@query(f"{_SCORE} SELECT frame_no FROM (SELECT frame_no, row_number() OVER (ORDER BY c DESC, frame_no DESC) AS k FROM q) WHERE k = 1")
def best_thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrast = P.total("p", lambda x: x * x) * F.size("p") - P.total("p") * P.total("p")
    return _frames(spark, sf_dir).agg(F.max_by("frame_no", F.struct(contrast, F.col("frame_no"))).alias("frame_no"))


@query(f"{_SCORE} SELECT frame_no, s FROM q ORDER BY s DESC, frame_no LIMIT 10")
def fingerprint_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", P.total("p").alias("s")).orderBy(F.col("s").desc(), "frame_no").limit(10)


@query(f"{FR}, n AS (SELECT count(*) AS n FROM frames) SELECT frame_no FROM frames, n WHERE frame_no % ((n - 1) // 12) = 0 AND frame_no // ((n - 1) // 12) < 12")
def thumbnail_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n"))  # a single row
    step = F.expr("(n - 1) div 12")
    return rows.crossJoin(F.broadcast(n)).filter((F.col("frame_no") % step == 0) & (F.expr("frame_no div ((n - 1) div 12)") < 12)).select("frame_no")


@query(f"{FR}, n AS (SELECT max(frame_no) + 1 AS n FROM frames), k AS (SELECT unnest(range(n * 5 // 4)) AS k, n FROM n) SELECT k AS out_frame, k * 4 // 5 AS low, least(k * 4 // 5 + 1, n - 1) AS high, round(k * 4 / 5.0 - k * 4 // 5, 6) AS part FROM k")
def fps_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _frames(spark, sf_dir).agg((F.max("frame_no") + 1).alias("n")).withColumn("stream", F.lit(0))
    return M.rate_grid(sources, 4, 5).drop("stream").withColumn("part", F.round("part", 6))


@query(f"{FR}, t AS (SELECT frame_no, row_number() OVER (ORDER BY frame_no) - 1 AS i FROM frames), r AS (SELECT frame_no, unnest(range([3, 2, 3, 2][i % 4 + 1])) AS copy FROM t) SELECT frame_no, copy FROM r")
def telecine_pulldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pulldown(_frames(spark, sf_dir), "3:2").select("frame_no", "copy")


@query(f"{PX} SELECT frame_no, CAST(sum((v & 1) << (k % 8)::INTEGER) AS BIGINT) AS folded FROM pixels GROUP BY 1")
def lsb_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(F.col("p"), lambda v, k: v.bitwiseAND(1) * F.pow(F.lit(2.0), k % 8).cast("int"))
    return _frames(spark, sf_dir).select("frame_no", P.total(bits).alias("folded"))


@query(f"{PX} SELECT frame_no, round(100.0 * avg((v % 4 <> 0)::INTEGER), 6) AS share, avg((v % 4 <> 0)::INTEGER) > 0.1 AS true_ten_bit FROM pixels GROUP BY 1")
def true_ten_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", F.round(P.low_bits_share("p") * 100, 6).alias("share"), P.true_ten_bit("p").alias("true_ten_bit"))


@query(f"""{PX}, d AS (SELECT a.frame_no, sum(abs(a.v - b.v)) / (56 * 255.0::DOUBLE) AS s FROM pixels a JOIN pixels b ON a.frame_no = b.frame_no AND b.k = a.k + 1 AND a.k % 8 <> 7 GROUP BY 1), m AS (SELECT frame_no, avg(v) / 255 AS l, least(1, (sum(v * v) * 64 - sum(v) * sum(v)) / 4096.0 / 65025) AS c FROM pixels GROUP BY 1)
SELECT frame_no, round(least(1, greatest(0, 0.15 * l + 0.25 * c + 0.3 * s + 0.15 * 0.5 + 0.15 * (1 - (1 - s)))), 6) AS score FROM m JOIN d USING (frame_no)""")
def frame_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharp = P.sharpness("p", 8)
    score = P.quality_score(P.average_luma("p"), P.spatial_complexity("p"), sharp, F.lit(0.5), 1 - sharp)
    return _frames(spark, sf_dir).select("frame_no", F.round(score, 6).alias("score"))


@query(f"{PX} SELECT frame_no, k // 8 AS \"row\", round(v * (k // 8) / 8 * 0.5::DOUBLE, 6) AS shift FROM pixels WHERE k % 8 = 0")
def rolling_shutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _frames(spark, sf_dir).select("frame_no", F.posexplode("p").alias("k", "v")).filter("k % 8 = 0")
    line = F.expr("k div 8")
    return pixels.select("frame_no", line.alias("row"), F.round(P.rolling_shutter_shift(F.col("v"), line, 8, 0.5), 6).alias("shift"))



@query(f"WITH {views.FRAMES}, t AS (SELECT unnest([999, 5000, 12345]) AS t), r AS (SELECT t, frame_no, row_number() OVER (PARTITION BY t ORDER BY abs(frame_no * 40 - t), frame_no) AS k FROM t, frames) SELECT CAST(t AS INTEGER) AS ms, frame_no FROM r WHERE k = 1")
def thumbnail_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest frame to each asked time: a minimum for each of a bounded list of times, in one scan."""
    times = (999, 5000, 12345)
    near = [F.min_by("frame_no", F.struct(F.abs(F.col("frame_no") * 40 - t), F.col("frame_no"))).alias(str(t)) for t in times]
    found = _frames(spark, sf_dir).agg(*near)
    return found.select(F.explode(F.array(*[F.struct(F.lit(t).alias("ms"), F.col(str(t)).alias("frame_no")) for t in times])).alias("x")).select("x.*")
