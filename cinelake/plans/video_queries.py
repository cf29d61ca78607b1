"""Queries over whole frames as bytes, with SQL over their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels
from ..operators import selection as T
from ..operators import video as V
from . import views
from .registration import query

RGB = f"WITH {views.RGB}"
YUV = f"WITH {views.YUV}"
ROWS = f"{RGB}, px AS (SELECT stream, frame_no, unnest(d) AS v, unnest(range(len(d))) AS k FROM rgb), cell AS (SELECT stream, frame_no, CAST(k // 15 AS INTEGER) AS y, CAST(k // 3 % 5 AS INTEGER) AS x, k % 3 AS c, v FROM px)"
#: Pixels with their three channels, and luma in single precision.
DOTS = f"{ROWS}, dot AS (SELECT stream, frame_no, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM cell GROUP BY ALL), lum AS (SELECT *, 0.2126::FLOAT * r::FLOAT + 0.7152::FLOAT * g::FLOAT + 0.0722::FLOAT * b::FLOAT AS l FROM dot)"


def _bytes(df: DataFrame) -> DataFrame:
    """Frames with their data as hexadecimal text, for comparison by value."""
    return df.select("stream", "frame_no", "width", "height", F.lower(F.hex("data")).alias("data"))


def _hex(items: str, width: int, height: int, source: str = "yuv") -> str:
    return f"SELECT stream, frame_no, {width} AS width, {height} AS height, array_to_string(list_transform({items}, lambda v: lower(printf('%02x', CAST(v AS INTEGER)))), '') AS data FROM {source}"


def _moved(rule: str, width: int, height: int) -> str:
    """YUV frames of 8x8 whose plane pixel (y, x) is the old plane's pixel at ``rule`` of ``s`` (the old side), ``y`` and ``x``."""
    part = lambda first, side, w, h: f"[d[{first} + ({rule.replace('S', str(side)).replace('Y', f'(k // {w})').replace('X', f'(k % {w})')}) + 1] for k in range({w * h})]"
    planes = [part(0, 8, width, height), part(64, 4, width // 2, height // 2), part(80, 4, width // 2, height // 2)]
    return f"{YUV} {_hex(f'list_concat({planes[0]}, list_concat({planes[1]}, {planes[2]}))', width, height)}"


@query(_moved("(Y + S // 4) * S + X + S // 2", 4, 2).replace("8 // 2", "4").replace("4 // 2", "2"))
def crop_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.crop(views.yuv_frames(spark, sf_dir), 4, 2, 4, 2))


@query(_moved("(S - 1 - X) * S + Y", 8, 8))
def rotate_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.rotate(views.yuv_frames(spark, sf_dir), 450))


@query(_moved("(S - 1 - Y) * S + S - 1 - X", 8, 8))
def flip_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.flip(views.yuv_frames(spark, sf_dir), True, True))


def _weighted(first: int, side: int, width: int, height: int) -> str:
    """A plane of ``d`` scaled by Lanczos weights, as a list."""
    down, across = kernels.lanczos_weights(side, height), kernels.lanczos_weights(side, width)
    rows = ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in w) + "]" for w in down.tolist())
    columns = ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in w) + "]" for w in across.tolist())
    line = " + ".join(f"w[{h + 1}] * d[{first + h * side} + x + 1]" for h in range(side))
    cell = " + ".join(f"m[{x + 1}] * u[{x + 1}]" for x in range(side))
    half = f"list_transform([{rows}], lambda w: list_transform(range({side}), lambda x: {line}))"
    return f"list_transform(flatten(list_transform({half}, lambda m: list_transform([{columns}], lambda u: {cell}))), lambda v: floor(greatest(0, least(255, round(v, 9)))))"


@query(f"{YUV} {_hex(f'list_concat({_weighted(0, 8, 6, 10)}, list_concat({_weighted(64, 4, 3, 5)}, {_weighted(80, 4, 3, 5)}))', 6, 10)}")
def scale_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.scale(views.yuv_frames(spark, sf_dir), 6, 10))


@query(f"""{RGB}, pix AS (SELECT stream, frame_no, unnest(range(16)) AS k, d FROM (SELECT stream, frame_no, d[1:48] AS d FROM rgb)), c AS (SELECT stream, frame_no, k, d[3 * k + 1] AS r, d[3 * k + 2] AS g, d[3 * k + 3] AS b FROM pix),
l AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM c), t AS (SELECT stream, frame_no, k, floor(round(y, 9)) AS y, floor(greatest(0, least(255, round((b - y) / 1.8556::DOUBLE + 128, 9)))) AS u, floor(greatest(0, least(255, round((r - y) / 1.5748::DOUBLE + 128, 9)))) AS v FROM l),
p AS (SELECT stream, frame_no, list_concat(list(y ORDER BY k), list_concat(list(u ORDER BY k) FILTER (k // 4 % 2 = 0 AND k % 2 = 0), list(v ORDER BY k) FILTER (k // 4 % 2 = 0 AND k % 2 = 0))) AS d FROM t GROUP BY 1, 2) {_hex('d', 4, 4, 'p')}""")
def rgb_frame_to_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.rgb_to_yuv420p(_four(spark, sf_dir)))


@query(f"""{YUV}, pix AS (SELECT stream, frame_no, unnest(range(64)) AS k, d FROM yuv), c AS (SELECT stream, frame_no, k, d[k + 1] AS y, d[64 + k // 16 * 4 + k % 8 // 2 + 1] - 128 AS u, d[80 + k // 16 * 4 + k % 8 // 2 + 1] - 128 AS v FROM pix),
t AS (SELECT *, y + 1.5748::DOUBLE * v AS r, y + 1.8556::DOUBLE * u AS b FROM c), g AS (SELECT *, (y - 0.2126::DOUBLE * r - 0.0722::DOUBLE * b) / 0.7152::DOUBLE AS g FROM t),
p AS (SELECT stream, frame_no, flatten(list([floor(greatest(0, least(255, round(r, 9)))), floor(greatest(0, least(255, round(g, 9)))), floor(greatest(0, least(255, round(b, 9))))] ORDER BY k)) AS d FROM g GROUP BY 1, 2) {_hex('d', 8, 8, 'p')}""")
def planes_to_rgb_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.yuv420p_to_rgb(views.yuv_frames(spark, sf_dir)))


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB frames of 4x4 pixels."""
    rows = views.rgb_frames(spark, sf_dir)
    return rows.select("stream", "frame_no", F.lit(4).alias("width"), F.lit(4).alias("height"), F.substring("data", 1, 48).alias("data"))


_ERRORS = ", ".join(f"sum(CASE WHEN k >= {a} AND k < {b} THEN (v - w) * (v - w) END) / {b - a}.0::DOUBLE AS {n}" for n, a, b in (("y", 0, 256), ("u", 256, 320), ("v", 320, 384)))
_RATIO = "CASE WHEN {0} = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025 / {0}) END"


@query(f"""WITH {views.WIDE}, px AS (SELECT a.stream, a.frame_no, unnest(a.d) AS v, unnest(b.d) AS w, unnest(range(384)) AS k FROM wide a JOIN wide b ON a.stream = b.stream AND b.frame_no = a.frame_no - 1), e AS (SELECT stream, frame_no, {_ERRORS} FROM px GROUP BY 1, 2),
r AS (SELECT *, {', '.join(f"{_RATIO.format(p)} AS p{p}" for p in 'yuv')} FROM e) SELECT stream, frame_no, round(y, 6) AS mse_y, round(u, 6) AS mse_u, round(v, 6) AS mse_v, round((6 * py + pu + pv) / 8, 6) AS psnr_avg FROM r""")
def weighted_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.wide_frames(spark, sf_dir)
    before = rows.withColumn("frame_no", F.col("frame_no") + 1)
    made = V.compare(rows, before)
    return made.select("stream", "frame_no", *[F.round(c, 6).alias(c) for c in ("mse_y", "mse_u", "mse_v", "psnr_avg")])


_BINS = f"{DOTS}, ch AS (SELECT stream, frame_no, ['r', 'g', 'b'][c + 1] AS channel, v AS bin FROM cell UNION ALL SELECT stream, frame_no, 'luma', CAST(floor(l) AS INTEGER) FROM lum)"


@query(f"{_BINS} SELECT stream, frame_no, channel, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM ch GROUP BY ALL")
def rgb_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histograms(views.rgb_frames(spark, sf_dir))


@query(f"{ROWS}, n AS (SELECT stream, frame_no, c, sum((v < 20)::INTEGER) AS lo, sum((v > 235)::INTEGER) AS hi FROM cell GROUP BY ALL) SELECT stream, frame_no, {', '.join(f'bool_or(lo > 0 OR hi > 0) FILTER (c = {k}) AS {n}' for k, n in enumerate('rgb'))} FROM n GROUP BY 1, 2")
def histogram_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values within twenty of an end are moved to it first, so that some channels of the stand-in clip."""
    counts = V.histograms(views.rgb_frames(spark, sf_dir))
    return V.clipping(counts.withColumn("bin", F.when(F.col("bin") < 20, 0).when(F.col("bin") > 235, 255).otherwise(F.col("bin"))))


@query(f"{DOTS} SELECT stream, frame_no, round(avg((floor(l) < 127)::INTEGER), 6) AS level, avg((floor(l) < 127)::INTEGER) >= 0.6 AS black, round(avg(l::DOUBLE) / 255, 5) AS luma FROM lum GROUP BY 1, 2")
def dark_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.dark(views.rgb_frames(spark, sf_dir), 0.5, 0.6)
    return rows.select("stream", "frame_no", F.round("level", 6).alias("level"), "black", F.round("luma", 5).alias("luma"))


_INNER = f"{ROWS}, lap AS (SELECT m.stream, m.frame_no, m.y, m.x, m.c, any_value(m.v) AS v, 9 * any_value(m.v) - sum(n.v) AS d FROM cell m JOIN cell n USING (stream, frame_no, c) WHERE m.y BETWEEN 1 AND 2 AND m.x BETWEEN 1 AND 3 AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1 GROUP BY 1, 2, 3, 4, 5)"


@query(f"""{_INNER}, made AS (SELECT stream, frame_no, y, x, c, CAST(greatest(0, least(255, floor(v + CASE WHEN abs(d) / 8 > 30 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * (abs(d) / 8) / 30 END * d + 0.5::DOUBLE))) AS INTEGER) AS v FROM lap),
p AS (SELECT stream, frame_no, list(coalesce(made.v, cell.v) ORDER BY y, x, c) AS d FROM cell LEFT JOIN made USING (stream, frame_no, y, x, c) GROUP BY 1, 2) {_hex('d', 5, 4, 'p')}""")
def adaptive_sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.adaptive_sharpen(views.rgb_frames(spark, sf_dir), 0.5))


_QUALITY = f"""{_INNER}, dot AS (SELECT stream, frame_no, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM cell GROUP BY ALL), l AS (SELECT stream, frame_no, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS l, r, g, b FROM dot),
q AS (SELECT stream, frame_no, avg(floor(round(l, 9))) / 255 AS brightness, least(1, stddev_pop(l) / 73.9) AS contrast, least(1, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 / 73.9) AS color FROM l GROUP BY 1, 2), s AS (SELECT stream, frame_no, least(1, var_pop(d) / 1000) AS sharpness FROM lap WHERE c = 1 GROUP BY 1, 2),
m AS (SELECT a.stream, a.frame_no, least(1, avg(abs(a.v - b.v)) / 50) AS blur FROM cell a JOIN cell b ON b.stream = a.stream AND b.frame_no = a.frame_no - 1 AND b.y = a.y AND b.x = a.x AND b.c = a.c GROUP BY 1, 2),
whole AS (SELECT stream, frame_no, brightness, contrast, sharpness, color, coalesce(blur, 0) AS blur FROM q JOIN s USING (stream, frame_no) LEFT JOIN m USING (stream, frame_no)),
scored AS (SELECT *, greatest(0, least(1, 0.15 * (1 - abs(brightness - 0.5) * 2) + 0.25 * contrast + 0.3 * sharpness + 0.15 * color + 0.15 * (1 - blur))) AS score FROM whole)"""


@query(f"{_QUALITY} SELECT stream, frame_no, {', '.join(f'round({c}, 5) AS {c}' for c in ('brightness', 'contrast', 'sharpness', 'color', 'blur', 'score'))} FROM scored")
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.frame_quality(views.rgb_frames(spark, sf_dir))
    return rows.select("stream", "frame_no", *[F.round(c, 5).alias(c) for c in rows.columns[2:]])


@query(f"{_QUALITY} SELECT stream, max_by(frame_no, round(score, 5) * 100000 + frame_no / 10000.0) AS frame_no FROM scored GROUP BY 1")
def best_thumbnail_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of the best quality in each stream, the last of equals."""
    rows = V.frame_quality(views.rgb_frames(spark, sf_dir))
    return rows.groupBy("stream").agg(F.max_by("frame_no", F.struct(F.round("score", 5), "frame_no")).alias("frame_no"))


@query(f"""{DOTS}, h AS (SELECT stream, frame_no, r * 4 // 256 AS r, g * 4 // 256 AS g, b * 4 // 256 AS b, count(*) / 20.0 AS n FROM dot GROUP BY ALL), two AS (SELECT stream, frame_no, r, g, b, n AS x, 0 AS y FROM h UNION ALL SELECT stream, frame_no + 1, r, g, b, 0, n FROM h),
one AS (SELECT stream, frame_no, r, g, b, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM two GROUP BY ALL), d AS (SELECT stream, frame_no, least(1, sum((x - y) * (x - y) / (x + y)) / 2) AS d FROM one GROUP BY 1, 2)
SELECT stream, frame_no, round(CASE WHEN frame_no = 0 THEN 0 ELSE d END, 6) AS distance, frame_no > 0 AND d > 0.40001 AS scene FROM (SELECT DISTINCT stream, frame_no FROM dot) JOIN d USING (stream, frame_no)""")
def color_scene_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bins a channel, as the stand-in's frames have twenty pixels."""
    rows = V.scene_distance(views.rgb_frames(spark, sf_dir), 4)
    return rows.select("stream", "frame_no", F.round("distance", 6).alias("distance"), (F.col("distance") > 0.40001).alias("scene"))


@query(f"""{DOTS}, mo AS (SELECT a.stream, a.frame_no, avg(abs(a.v - b.v)) / 255 AS m FROM px a JOIN px b ON b.stream = a.stream AND b.frame_no = a.frame_no - 1 AND b.k = a.k AND a.k % 12 = 0 GROUP BY 1, 2),
bins AS (SELECT stream, frame_no, floor(l) AS bin, 1 AS x, 0 AS y FROM lum UNION ALL SELECT stream, frame_no + 1, floor(l), 0, 1 FROM lum), c AS (SELECT stream, frame_no, bin, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM bins GROUP BY ALL), ch AS (SELECT stream, frame_no, least(1, sum((x - y) * (x - y) / (x + y)) / 1000) AS h FROM c GROUP BY 1, 2),
ed AS (SELECT p.stream, p.frame_no, least(1, avg(sqrt(power(r.l::DOUBLE - q.l, 2) + power(u.l::DOUBLE - t.l, 2))) / 255) AS e FROM lum p JOIN lum q ON q.stream = p.stream AND q.frame_no = p.frame_no AND q.y = p.y AND q.x = p.x - 1 JOIN lum r ON r.stream = p.stream AND r.frame_no = p.frame_no AND r.y = p.y AND r.x = p.x + 1
 JOIN lum t ON t.stream = p.stream AND t.frame_no = p.frame_no AND t.x = p.x AND t.y = p.y - 1 JOIN lum u ON u.stream = p.stream AND u.frame_no = p.frame_no AND u.x = p.x AND u.y = p.y + 1 GROUP BY 1, 2)
SELECT stream, frame_no, round(CASE WHEN frame_no = 0 THEN 0 ELSE m END, 6) AS motion, round(CASE WHEN frame_no = 0 THEN 0 ELSE h END, 6) AS change, round(e, 4) AS edges, round(CASE WHEN frame_no = 0 THEN 0 ELSE 0.4 * m + 0.3 * h END + 0.3 * e, 4) AS score FROM ed LEFT JOIN mo USING (stream, frame_no) LEFT JOIN ch USING (stream, frame_no)""")
def frame_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.importance(views.rgb_frames(spark, sf_dir))
    return rows.select("stream", "frame_no", F.round("motion", 6).alias("motion"), F.round("change", 6).alias("change"), F.round("edges", 4).alias("edges"), F.round("score", 4).alias("score"))


@query(f"""{ROWS}, near AS (SELECT a.stream, a.frame_no, a.k, a.v AS now, b.v, CASE WHEN abs(a.v - b.v) < 12 THEN 1.0::DOUBLE ELSE 1 / (1 + abs(a.v - b.v) / 12.0::DOUBLE) END AS w FROM px a JOIN px b ON b.stream = a.stream AND b.k = a.k AND b.frame_no BETWEEN a.frame_no - 2 AND a.frame_no),
m AS (SELECT stream, frame_no, k, CAST(floor(round(any_value(now) * 0.25::DOUBLE + sum(v * w) / sum(w) * 0.75::DOUBLE, 9) + 0.5::DOUBLE) AS INTEGER) AS v FROM near GROUP BY 1, 2, 3), p AS (SELECT stream, frame_no, list(v ORDER BY k) AS d FROM m GROUP BY 1, 2) {_hex('d', 5, 4, 'p')}""")
def motion_weighted_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.temporal_denoise(views.rgb_frames(spark, sf_dir), 3, 0.75, 12.0))


@query(f"""{RGB}, held AS (SELECT stream, frame_no, CASE WHEN frame_no % 10 BETWEEN 4 AND 6 + stream % 2 THEN frame_no // 10 * 10 + 3 ELSE frame_no END AS src FROM rgb), z AS (SELECT h.stream, h.frame_no, d FROM held h JOIN rgb r ON r.stream = h.stream AND r.frame_no = h.src),
s AS (SELECT a.stream, a.frame_no, list_sum([abs(a.d[k + 1] - b.d[k + 1]) for k in range(60)]) / 60.0 / 255 AS e FROM z a JOIN z b ON b.stream = a.stream AND b.frame_no = a.frame_no - 1), e AS (SELECT stream, max(frame_no) AS e FROM z GROUP BY 1),
r AS (SELECT stream, frame_no, frame_no - row_number() OVER (PARTITION BY stream ORDER BY frame_no) AS g FROM s WHERE 1 - e >= 0.999) SELECT stream, min(frame_no) - 1 AS start, max(frame_no) + 1 AS stop FROM r JOIN e USING (stream) GROUP BY stream, g, e HAVING count(*) >= 2 AND max(frame_no) < e""")
def freeze_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or four frames of every ten repeat the one before them."""
    rows = views.rgb_frames(spark, sf_dir)
    tenth = F.col("frame_no") % 10
    source = F.when(tenth.between(4, 6 + F.col("stream") % 2), F.col("frame_no") - tenth + 3).otherwise(F.col("frame_no"))
    old = rows.select("stream", F.col("frame_no").alias("_src"), "data")
    return V.freezes(rows.drop("data").withColumn("_src", source).join(old, ["stream", "_src"]))


_BLOCKS = f"""WITH {views.WIDE}, px AS (SELECT a.stream, a.frame_no, unnest(a.d) AS v, unnest(b.d) AS w, unnest(range(384)) AS k FROM wide a JOIN wide b ON a.stream = b.stream AND b.frame_no = a.frame_no - 1),
pl AS (SELECT stream, frame_no, 'y' AS p, k // 16 AS y, k % 16 AS x, v, w FROM px WHERE k < 256 UNION ALL SELECT stream, frame_no, CASE WHEN k < 320 THEN 'u' ELSE 'v' END, k % 64 // 8, k % 8, v, w FROM px WHERE k >= 256),
bl AS (SELECT stream, frame_no, p, oy, ox, avg(v::DOUBLE) AS a, avg(w::DOUBLE) AS b, avg(v::DOUBLE * v) AS aa, avg(w::DOUBLE * w) AS bb, avg(v::DOUBLE * w) AS ab FROM pl, (VALUES (0), (4), (8)) AS s(oy), (VALUES (0), (4), (8)) AS t(ox) WHERE y >= oy AND y < oy + 8 AND x >= ox AND x < ox + 8 GROUP BY ALL HAVING count(*) = 64),
sc AS (SELECT stream, frame_no, p, avg(greatest(0, least(1, (2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225))))) AS s FROM bl GROUP BY 1, 2, 3)"""


@query(f"{_BLOCKS} SELECT stream, frame_no, round(max(s) FILTER (p = 'y'), 6) AS ssim_y, round((6 * max(s) FILTER (p = 'y') + max(s) FILTER (p = 'u') + max(s) FILTER (p = 'v')) / 8, 6) AS ssim_avg FROM sc GROUP BY 1, 2")
def weighted_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping blocks of 8x8 pixels, four apart."""
    rows = views.wide_frames(spark, sf_dir)
    made = V.compare(rows, rows.withColumn("frame_no", F.col("frame_no") + 1))
    return made.select("stream", "frame_no", F.round("ssim_y", 6).alias("ssim_y"), F.round("ssim_avg", 6).alias("ssim_avg"))


@query(f"{_BLOCKS}, m AS (SELECT stream, frame_no, round(max(s) FILTER (p = 'y'), 5) AS s FROM sc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY s DESC, frame_no DESC) AS k FROM m) SELECT stream, frame_no FROM r WHERE k = 1")
def best_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar pair of each stream, the last of equals."""
    rows = views.wide_frames(spark, sf_dir)
    made = V.compare(rows, rows.withColumn("frame_no", F.col("frame_no") + 1))
    return made.groupBy("stream").agg(F.max_by("frame_no", F.struct(F.round("ssim_y", 5), "frame_no")).alias("frame_no"))


@query()
def frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hashes(views.rgb_frames(spark, sf_dir))


@query()
def timecode_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(V.overlay(views.rgb_frames(spark, sf_dir), F.format_string("%d", "frame_no"), 0, 0, 1))


#: A score, a time and a hash of each frame of the RGB stand-in, from sums of its bytes.
FACTS = f"{RGB}, facts AS (SELECT stream, frame_no, list_sum(d)::BIGINT % 1000 AS score, frame_no * 0.04::DOUBLE AS time, list_sum(d)::BIGINT * 2654435761 AS hash FROM rgb)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir)
    total = F.aggregate(F.slice("p", 1, 60), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select((F.col("frame_no") % 7).alias("stream"), F.expr("frame_no div 7").alias("frame_no"), (total % 1000).alias("score"), (F.expr("frame_no div 7") * 0.04).alias("time"), (total * 2654435761).alias("hash"))


@query(f"{FACTS}, k AS (SELECT stream, unnest(range(12)) AS i, least(24, count(*)) / 12.0::DOUBLE AS step FROM facts GROUP BY 1) SELECT DISTINCT stream, CAST(floor(i * greatest(step, 1)) AS BIGINT) AS frame_no FROM k SEMI JOIN facts ON facts.stream = k.stream AND facts.frame_no = CAST(floor(i * greatest(step, 1)) AS BIGINT)")
def fingerprint_uniform_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.uniform(_facts(spark, sf_dir), 12).select("stream", "frame_no")


_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, frame_no) - 1 AS place FROM {0})"


@query(f"{FACTS}, {_TOP.format('facts')} SELECT stream, string_agg(hash, ',' ORDER BY place) AS hashes FROM t WHERE place < 8 GROUP BY 1")
def fingerprint_top_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.fingerprints(T.top(_facts(spark, sf_dir), 8))
    return made.withColumn("hashes", F.array_join(F.transform("hashes", lambda h: h.cast("string")), ","))


@query(f"{FACTS}, n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY frame_no) AS k FROM facts), a AS (SELECT * FROM n WHERE k <= 5 OR score >= 900), {_TOP.format('a')} SELECT stream, frame_no FROM t WHERE place < 10")
def fingerprint_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.adaptive(_facts(spark, sf_dir), 900, 5, 10).select("stream", "frame_no")


@query(f"{FACTS}, {_TOP.format('facts')}, l AS (SELECT stream, list(hash ORDER BY place) AS h FROM t WHERE place < 8 - stream // 5 GROUP BY 1) SELECT a.stream, b.stream AS other, CASE WHEN len(a.h) = len(b.h) THEN CAST(list_sum([bit_count(xor(a.h[k + 1], b.h[k + 1])) for k in range(len(a.h))]) AS BIGINT) END AS distance, CASE WHEN len(a.h) = len(b.h) THEN round(1 - list_sum([bit_count(xor(a.h[k + 1], b.h[k + 1])) for k in range(len(a.h))]) / (64.0::DOUBLE * len(a.h)), 6) ELSE 0 END AS similarity FROM l a JOIN l b ON b.stream = a.stream + 1")
def fingerprint_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's list against the next one's; the later streams have shorter lists."""
    chosen = T.top(_facts(spark, sf_dir), 8).filter(F.col("place") < 8 - F.expr("stream div 5"))
    lists = T.fingerprints(chosen)
    after = lists.select((F.col("stream") - 1).alias("stream"), F.col("hashes").alias("_other"))
    both = lists.join(after, "stream")
    return both.select("stream", (F.col("stream") + 1).alias("other"), T.list_distance(F.col("hashes"), F.col("_other")).alias("distance"), F.round(T.list_similarity(F.col("hashes"), F.col("_other")), 6).alias("similarity"))


_NEAR = "(SELECT stream, arg_min(frame_no, floor(round(abs(time - 1.0::DOUBLE) * 1000, 6)) * 100000 + frame_no) AS frame_no FROM facts GROUP BY 1)"


@query(f"{FACTS} SELECT 'first' AS method, stream, min(frame_no) AS frame_no FROM facts GROUP BY 2 UNION ALL SELECT 'middle', stream, count(*) // 2 FROM facts GROUP BY 2 UNION ALL SELECT 'timestamp', stream, frame_no FROM {_NEAR} UNION ALL SELECT 'index', stream, 17 FROM facts GROUP BY 2 UNION ALL SELECT 'smart', stream, arg_max(frame_no, score * 100000 + frame_no) FROM facts GROUP BY 2")
def thumbnail_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir)
    made = [T.thumbnail(rows, m, v).select(F.lit(m).alias("method"), "stream", "frame_no") for m, v in (("first", None), ("middle", None), ("timestamp", 1.0), ("index", 17), ("smart", None))]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


@query(f"""{_QUALITY}, q2 AS (SELECT stream, frame_no, round(brightness, 5) AS b, round(contrast, 5) AS c FROM scored), mid AS (SELECT stream, list_sort(list(b))[count(*) // 2 + 1] AS mb, list_sort(list(c))[count(*) // 2 + 1] AS mc FROM q2 GROUP BY 1)
SELECT stream, arg_min(frame_no, floor(round((abs(b - mb) + abs(c - mc)) * 1000, 6)) * 100000 + frame_no) AS frame_no FROM q2 JOIN mid USING (stream) GROUP BY 1""")
def representative_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = V.frame_quality(views.rgb_frames(spark, sf_dir))
    return T.thumbnail(quality.select("stream", "frame_no", F.round("brightness", 5).alias("brightness"), F.round("contrast", 5).alias("contrast")), "representative")


@query(f"{FACTS} SELECT score % 10 AS version, arg_max(frame_no, time * 1000 + stream / 10.0) AS frame_no, arg_max(stream, time * 1000 + stream / 10.0) AS stream FROM facts GROUP BY 1")
def best_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group of versions, the last of equals."""
    rows = _facts(spark, sf_dir).withColumn("version", F.col("score") % 10)
    return T.best_by(rows, "version", "time", "stream").select("version", "frame_no", "stream")


@query(f"{DOTS}, y AS (SELECT stream, frame_no, round(avg(l::DOUBLE) / 255, 5) AS y FROM lum GROUP BY 1, 2), e AS (SELECT stream, max(frame_no) AS e FROM y GROUP BY 1) SELECT a.stream, a.frame_no AS start, a.frame_no + 5 AS stop FROM y a JOIN y b ON b.stream = a.stream AND b.frame_no = a.frame_no + 4 JOIN e ON e.stream = a.stream WHERE a.y > 0.501 AND b.y < 0.499 AND a.frame_no + 5 <= e")
def fade_to_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.dark(views.rgb_frames(spark, sf_dir)).select("stream", "frame_no", F.round("luma", 5).alias("luma"))
    return V.fades(rows, 5, 0.501, 0.499)
