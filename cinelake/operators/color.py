"""Colour science in column functions: matrices, transfer functions, tone mapping and alpha blending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import clamp8

#: Luma weights (red, blue) of the colour standards.
WEIGHTS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}
#: Linear RGB to XYZ of the colour gamuts.
TO_XYZ = {
    "bt709": ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)),
    "bt2020": ((0.6369580, 0.1446169, 0.1688810), (0.2627002, 0.6779981, 0.0593017), (0.0000000, 0.0280727, 1.0609851)),
    "p3": ((0.4865709, 0.2656677, 0.1982173), (0.2289746, 0.6917385, 0.0792869), (0.0000000, 0.0451134, 1.0439444)),
}


def power(x: Column, p: float) -> Column:
    return F.pow(x, F.lit(p))


def yuv_to_rgb(y: Column, u: Column, v: Column, standard: str = "bt601", limited: bool = False) -> Column:
    """Clamped, then truncated."""
    kr, kb = WEIGHTS[standard]
    luma = (y - 16) * (255 / 219) if limited else y
    scale = 255 / 224 if limited else 1.0
    cb, cr = (u - 128) * scale, (v - 128) * scale
    r, b = luma + 2 * (1 - kr) * cr, luma + 2 * (1 - kb) * cb
    g = (luma - kr * r - kb * b) / (1 - kr - kb)
    return F.struct(*[F.floor(F.round(clamp8(x), 9)).cast("int").alias(n) for n, x in (("r", r), ("g", g), ("b", b))])


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Six sectors of the hue; truncated to 0..255."""
    c = v * s
    part = h / 60
    x = c * (1 - F.abs(part - 2 * F.floor(part / 2) - 1))
    sector = F.floor(part) % 6
    pick = lambda first: F.element_at(F.array(*first), (sector + 1).cast("int"))
    zero = F.lit(0.0)
    r, g, b = pick([c, x, zero, zero, x, c]), pick([x, c, c, x, zero, zero]), pick([zero, zero, x, c, c, x])
    return F.struct(*[F.floor(F.round((q + v - c) * 255, 9)).cast("int").alias(n) for n, q in (("r", r), ("g", g), ("b", b))])


def matrix3(m: tuple, r: Column, g: Column, b: Column) -> list[Column]:
    return [row[0] * r + row[1] * g + row[2] * b for row in m]


def inverse3(m: tuple) -> tuple:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in row) for row in rows)


def convert_gamut(r: Column, g: Column, b: Column, source: str, target: str, clip: bool = True) -> Column:
    """Linear RGB through XYZ; colours outside the target are clipped if asked."""
    out = matrix3(inverse3(TO_XYZ[target]), *matrix3(TO_XYZ[source], r, g, b))
    return F.array(*[F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if clip else x for x in out])


def to_linear(x: Column, transfer: str) -> Column:
    """Electro-optical transfer of a signal within one."""
    if transfer == "srgb":
        return F.when(x <= 0.04045, x / 12.92).otherwise(power((x + 0.055) / 1.055, 2.4))
    if transfer == "bt709":
        return F.when(x < 0.081, x / 4.5).otherwise(power((x + 0.099) / 1.099, 1 / 0.45))
    if transfer == "pq":
        m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
        p = power(x, 1 / m2)
        return power(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), 1 / m1)
    if transfer == "hlg":
        a, b, c = 0.17883277, 0.28466892, 0.55991073
        return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - c) / a) + b) / 12)
    if transfer == "linear":
        return x
    return power(x, float(transfer))


def from_linear(x: Column, transfer: str) -> Column:
    """The inverse of ``to_linear``."""
    if transfer == "srgb":
        return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * power(x, 1 / 2.4) - 0.055)
    if transfer == "bt709":
        return F.when(x < 0.018, x * 4.5).otherwise(1.099 * power(x, 0.45) - 0.099)
    if transfer == "pq":
        m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
        p = power(x, m1)
        return power((c1 + c2 * p) / (1 + c3 * p), m2)
    if transfer == "hlg":
        a, b, c = 0.17883277, 0.28466892, 0.55991073
        return F.when(x <= 1 / 12, F.sqrt(3 * x)).otherwise(a * F.log(F.greatest(12 * x - b, F.lit(1e-12))) + c)
    if transfer == "linear":
        return x
    return power(x, 1 / float(transfer))


def tone_map(x: Column, source_peak: float, target_peak: float, knee: float) -> Column:
    """Scaled by the ratio of the peaks; above the knee the excess e becomes e * r / (e + r)."""
    y = x * (target_peak / source_peak)
    room, over = 1 - knee, y - knee
    return F.when(y <= knee, y).otherwise(knee + over * room / (over + room))


def blend(mode: str, s: Column, d: Column, sa: Column) -> Column:
    """Premultiplied source over background by mode, within 255."""
    over = s + F.floor(d * (255 - sa) / 255)
    made = {"over": over, "add": s + d, "multiply": F.floor(s * d / 255), "screen": s + d - F.floor(s * d / 255), "source": s}[mode]
    return F.least(made, F.lit(255)).cast("int")


def luma_mask(r: Column, g: Column, b: Column) -> Column:
    return F.floor(F.round(0.2126 * r + 0.7152 * g + 0.0722 * b, 9)).cast("int")


def ordered_dither(v: Column, x: Column, y: Column) -> Column:
    """Ten bits to eight with a 4x4 threshold matrix."""
    # The 4x4 Bayer matrix.
    bayer = F.array(*map(F.lit, (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)))
    raised = v + F.get(bayer, (x % 4 + 4 * (y % 4)).cast("int"))
    return F.floor(F.least(raised, F.lit(1023)) * 255 / 1023).cast("int")


def fit(width: Column, height: Column, to_width: int, to_height: int, mode: str) -> Column:
    """Size of a frame in a target: fit, fill or stretch (letterbox and pillarbox fit, and pad)."""
    if mode == "stretch":
        return F.struct(F.lit(to_width).alias("width"), F.lit(to_height).alias("height"))
    wide = F.lit(to_width) * height <= F.lit(to_height) * width
    by_width = F.struct(F.lit(to_width).alias("width"), F.floor(height * to_width / width).cast("int").alias("height"))
    by_height = F.struct(F.floor(width * to_height / height).cast("int").alias("width"), F.lit(to_height).alias("height"))
    return F.when(wide, by_height if mode == "fill" else by_width).otherwise(by_width if mode == "fill" else by_height)
