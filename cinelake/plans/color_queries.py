"""Queries of the colour and kernel operators over the frames stand-in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import color as K
from ..operators import kernels
from ..operators import pixels as P
from ..operators.chain import FilterChain
from . import views
from .frame_queries import FR, PX, _frames, _sql_text, _text
from .registration import query

RGB = f"WITH {views.FRAMES}, c AS (SELECT frame_no, p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d, p[5] AS e FROM frames)"


def _at(k: int) -> Column:
    return P.at("p", F.lit(k))


@query(f"""{RGB}, y AS (SELECT frame_no, a + 1.402::DOUBLE * (c - 128) AS r, a + 1.772::DOUBLE * (b - 128) AS bl, a AS y FROM c), g AS (SELECT *, (y - 0.299::DOUBLE * r - 0.114::DOUBLE * bl) / 0.587::DOUBLE AS g FROM y)
SELECT frame_no, CAST(floor(round(greatest(0, least(255, r)), 9)) AS INTEGER) AS r, CAST(floor(round(greatest(0, least(255, g)), 9)) AS INTEGER) AS g, CAST(floor(round(greatest(0, least(255, bl)), 9)) AS INTEGER) AS b FROM g""")
def yuv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", K.yuv_to_rgb(_at(0), _at(1), _at(2)).alias("c")).select("frame_no", "c.*")


@query(f"""{RGB}, h AS (SELECT frame_no, (a * 360 // 256)::DOUBLE AS h, b / 255.0::DOUBLE AS s, c / 255.0::DOUBLE AS v FROM c), x AS (SELECT *, v * s AS ch, v * s * (1 - abs(h / 60 - 2 * floor(h / 120) - 1)) AS x, v - v * s AS m, CAST(floor(h / 60) AS INTEGER) % 6 + 1 AS k FROM h)
SELECT frame_no, CAST(floor(round(([ch, x, 0, 0, x, ch][k] + m) * 255, 9)) AS INTEGER) AS r, CAST(floor(round(([x, ch, ch, x, 0, 0][k] + m) * 255, 9)) AS INTEGER) AS g, CAST(floor(round(([0, 0, x, ch, ch, x][k] + m) * 255, 9)) AS INTEGER) AS b FROM x""")
def hsv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.floor(_at(0) * 360 / 256).cast("double")
    return _frames(spark, sf_dir).select("frame_no", K.hsv_to_rgb(h, _at(1) / 255.0, _at(2) / 255.0).alias("c")).select("frame_no", "c.*")


@query(f"""{RGB}, x AS (SELECT frame_no, a / 255.0::DOUBLE AS x FROM c) SELECT frame_no, round(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END, 6) AS srgb, round(CASE WHEN x < 0.081 THEN x / 4.5 ELSE pow((x + 0.099) / 1.099, 1 / 0.45) END, 6) AS bt709,
 round(pow(greatest(pow(x, 32 / 2523.0::DOUBLE) - 3424 / 4096.0::DOUBLE, 0) / (2413 / 128.0::DOUBLE - 2392 / 128.0::DOUBLE * pow(x, 32 / 2523.0::DOUBLE)), 16384 / 2610.0::DOUBLE), 6) AS pq, round(CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 6) AS hlg FROM x""")
def transfer_to_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _at(0) / 255.0
    return _frames(spark, sf_dir).select("frame_no", *[F.round(K.to_linear(x, t), 6).alias(t) for t in ("srgb", "bt709", "pq", "hlg")])


@query(f"{RGB} SELECT frame_no, round(a / 255.0, 5) AS srgb, round(a / 255.0, 5) AS bt709, round(a / 255.0, 5) AS pq, round(a / 255.0, 5) AS hlg FROM c")
def transfer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _at(0) / 255.0
    return _frames(spark, sf_dir).select("frame_no", *[F.round(K.from_linear(K.to_linear(x, t), t), 5).alias(t) for t in ("srgb", "bt709", "pq", "hlg")])


@query(f"{RGB} SELECT frame_no, round(a / 255.0, 4) AS r, round(b / 255.0, 4) AS g, round(c / 255.0, 4) AS b FROM c")
def gamut_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = K.convert_gamut(_at(0) / 255.0, _at(1) / 255.0, _at(2) / 255.0, "bt709", "bt2020", clip=False)
    rows = _frames(spark, sf_dir).select("frame_no", wide.alias("w"))
    back = K.convert_gamut(F.col("w")[0], F.col("w")[1], F.col("w")[2], "bt2020", "bt709", clip=False)
    return rows.select("frame_no", back.alias("c")).select("frame_no", *[F.round(F.col("c")[k], 4).alias(n) for k, n in enumerate("rgb")])


@query(f"{RGB}, y AS (SELECT frame_no, a / 255.0::DOUBLE * 2 AS y FROM c) SELECT frame_no, round(CASE WHEN y <= 0.75 THEN y ELSE 0.75 + (y - 0.75) * 0.25 / (0.25 + y - 0.75) END, 6) AS y FROM y")
def tone_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", F.round(K.tone_map(_at(0) / 255.0, 1.0, 2.0, 0.75), 6).alias("y"))


@query(f'{RGB} SELECT frame_no, least(a + b * (255 - c) // 255, 255) AS "over", least(a + b, 255) AS "add", a * b // 255 AS multiply, a + b - a * b // 255 AS screen, a AS source FROM c')
def blend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", *[K.blend(m, _at(0), _at(1), _at(2)).alias(m) for m in ("over", "add", "multiply", "screen", "source")])


@query(f"{RGB} SELECT frame_no, CAST(floor(round(0.2126::DOUBLE * a + 0.7152::DOUBLE * b + 0.0722::DOUBLE * c, 9)) AS INTEGER) AS mask FROM c")
def luma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_no", K.luma_mask(_at(0), _at(1), _at(2)).alias("mask"))


@query(_sql_text(f"{PX}, d AS (SELECT frame_no, k, least(v * 4 + [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5][k % 8 % 4 + 4 * (k // 8 % 4) + 1], 1023) * 255 // 1023 AS x FROM pixels) SELECT frame_no, list(x ORDER BY k) AS p FROM d GROUP BY 1"))
def ordered_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(_frames(spark, sf_dir).withColumn("p", F.transform("p", lambda v, k: K.ordered_dither(v * 4, k % 8, F.floor(k / 8)))))


@query("SELECT p_partkey, CASE WHEN 1920 * (p_partkey % 90 + 10) <= 1080 * (p_size + 10) THEN 1920 ELSE CAST((p_size + 10) * 1080 // (p_partkey % 90 + 10) AS INTEGER) END AS width, CASE WHEN 1920 * (p_partkey % 90 + 10) <= 1080 * (p_size + 10) THEN CAST((p_partkey % 90 + 10) * 1920 // (p_size + 10) AS INTEGER) ELSE 1080 END AS height FROM part")
def aspect_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.fit(F.col("p_size") + 10, F.col("p_partkey") % 90 + 10, 1920, 1080, "fit")
    return views.table(spark, sf_dir, "part").select("p_partkey", made.alias("f")).select("p_partkey", "f.*")


@query(f"{PX} SELECT frame_no, array_to_string(list(CAST(floor((v - 128) * 1.2::DOUBLE + 128 + 5) AS INTEGER) ORDER BY k // 8 * 8 + 7 - k % 8), ',') AS plane FROM pixels GROUP BY 1")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = FilterChain().add("contrast", lambda f: P.brightness_contrast(f, 5, 1.2)).add("flip", lambda f: P.flip(f, 8, 8))
    return _text(chain.apply(_frames(spark, sf_dir)))


def _matrix(w: np.ndarray) -> str:
    """Rows of weights as a list of lists, with all their digits."""
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in w.tolist()) + "]"


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


_BYTE = "CAST(floor(greatest(0, least(255, round({0}, 9)))) AS INTEGER)"
#: Lines of a plane of eight by eight, and of its columns.
_LINES = f"{FR}, lines AS (SELECT frame_no, p, list_transform(range(8), lambda y: list_transform(p[8 * y + 1 : 8 * y + 8], lambda v: v::DOUBLE)) AS l FROM frames)"


def _product(down: np.ndarray, across: np.ndarray) -> str:
    """Planes (as lines) times weights on both sides."""
    rows = _sum([f"w[{h + 1}] * l[{h + 1}][x + 1]" for h in range(down.shape[1])])
    cells = _sum([f"m[{x + 1}] * w[{x + 1}]" for x in range(across.shape[1])])
    return f"""half AS (SELECT frame_no, list_transform({_matrix(down)}, lambda w: list_transform(range(8), lambda x: {rows})) AS r FROM lines),
full_planes AS (SELECT frame_no, list_transform(r, lambda m: list_transform({_matrix(across)}, lambda w: {cells})) AS r FROM half)"""


_SCALED = f"{_LINES}, {_product(kernels.lanczos_weights(8, 12), kernels.lanczos_weights(8, 16))} SELECT frame_no, list_transform(flatten(r), lambda v: {_BYTE.format('v')}) AS p FROM full_planes"


@query(_sql_text(_SCALED))
def scale_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(kernels.scale(_frames(spark, sf_dir), 8, 8, 16, 12))


def _smoothing(sigma: float) -> np.ndarray:
    """Gaussian weights of each of eight places, those beyond an edge added to the edge."""
    w = kernels.gaussian_weights(sigma)
    out, r = np.zeros((8, 8)), len(w) // 2
    for y in range(8):
        for k, v in enumerate(w):
            out[y, min(max(y + k - r, 0), 7)] += v
    return out


_BLURRED = f"{_LINES}, {_product(_smoothing(1.0), _smoothing(1.0))}"


@query(_sql_text(f"{_BLURRED} SELECT frame_no, list_transform(flatten(r), lambda v: {_BYTE.format('v')}) AS p FROM full_planes"))
def gaussian_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(kernels.gaussian_denoise(_frames(spark, sf_dir), 8, 8, 1.0))


@query(_sql_text(f"{_BLURRED}, d AS (SELECT frame_no, p, flatten(r) AS b FROM full_planes JOIN frames USING (frame_no)) SELECT frame_no, list_transform(range(64), lambda k: {_BYTE.format('CASE WHEN abs(p[k + 1] - b[k + 1]) > 2 THEN p[k + 1] + 0.8::DOUBLE * (p[k + 1] - b[k + 1]) ELSE p[k + 1] END')}) AS p FROM d"))
def unsharp_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(kernels.unsharp(_frames(spark, sf_dir), 8, 8, 1.0, 0.8, 2.0))


_NEAR = f"""{PX}, near AS (SELECT a.frame_no, a.k, b.v, exp(-(dy * dy + dx * dx) / 8.0::DOUBLE - (b.v - a.v) * (b.v - a.v) / 1800.0::DOUBLE) AS w FROM pixels a, range(-2, 3) s(dy), range(-2, 3) t(dx), pixels b
WHERE b.frame_no = a.frame_no AND b.k = 8 * greatest(0, least(7, a.k // 8 + dy)) + greatest(0, least(7, a.k % 8 + dx)))"""


@query(_sql_text(f"{_NEAR}, m AS (SELECT frame_no, k, sum(w * v) / sum(w) AS x FROM near GROUP BY ALL) SELECT frame_no, list({_BYTE.format('x')} ORDER BY k) AS p FROM m GROUP BY 1"))
def bilateral_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(kernels.bilateral(_frames(spark, sf_dir), 8, 8, 2, 2.0, 30.0))


_DIFFUSED = f"""WITH RECURSIVE {views.FRAMES}, fold AS (SELECT frame_no, 0 AS k, list_transform(p, lambda v: v * 4) AS p, []::INTEGER[] AS made FROM frames
UNION ALL SELECT frame_no, k + 1, list_transform(range(64), lambda j: p[j + 1] + CASE WHEN j = k + 1 AND k % 8 < 7 THEN trunc(e * 7 / 16.0)::INTEGER WHEN j = k + 7 AND k % 8 > 0 THEN trunc(e * 3 / 16.0)::INTEGER WHEN j = k + 8 THEN trunc(e * 5 / 16.0)::INTEGER WHEN j = k + 9 AND k % 8 < 7 THEN trunc(e / 16.0)::INTEGER ELSE 0 END), list_append(made, n)
FROM (SELECT *, p[k + 1] - n * 1023 // 255 AS e FROM (SELECT *, greatest(0, least(1023, p[k + 1])) * 255 // 1023 AS n FROM fold WHERE k < 64)))
SELECT frame_no, made AS p FROM fold WHERE k = 64"""


@query(_sql_text(_DIFFUSED))
def error_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(kernels.floyd_steinberg(_frames(spark, sf_dir).withColumn("p", F.transform("p", lambda v: v * 4)), 8, 8))


_LOW = kernels.dct_matrix(32)[:8] @ kernels.bilinear_weights(8, 32)
_HASHED = f"{_LINES}, {_product(_LOW, _LOW)}, v AS (SELECT frame_no, list_transform(flatten(r), lambda v: round(v, 6)) AS v FROM full_planes), m AS (SELECT frame_no, v, list_sort(v)[33] AS middle FROM v) SELECT frame_no, (CASE WHEN v[1] > middle THEN -9223372036854775808 ELSE 0 END + list_sum(list_transform(range(1, 64), lambda k: CASE WHEN v[k + 1] > middle THEN 1::BIGINT << (63 - k) ELSE 0 END)))::BIGINT AS hash FROM m"


@query(_HASHED)
def perceptual_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.perceptual_hash(_frames(spark, sf_dir), 8, 8)


@query()
def multi_scale_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.following(_frames(spark, sf_dir)).filter("q IS NOT NULL")
    wide = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.get(F.col(c), (F.floor(y / 2) * 8 + F.floor(x / 2)).cast("int")))))
    return kernels.compare_planes(pairs.select("frame_no", wide("p").alias("p"), wide("q").alias("q")), 16, 16, kernels.multi_scale_ssim)
