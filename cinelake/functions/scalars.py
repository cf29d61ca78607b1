"""Column functions: rationals, time stamps, timecodes, and the parsers of command-line and cue values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _euclid(a: Column, b: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of the greatest common divisor, by Euclid's algorithm as a fold.

    A number below the golden ratio to the power n is through after n + 1 steps, so that the fold is no longer than its smaller
    number asks for.
    """
    a, b = F.abs(a.cast("long")), F.abs(b.cast("long"))
    steps = (F.log2(F.least(a, b).cast("double") + 1) * 1.4405).cast("int") + 3
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(a.alias("a"), b.alias("b")), step, lambda s: made(s["a"]))


def gcd(a: Column, b: Column) -> Column:
    return _euclid(a, b, lambda g: g)


def rational(num: Column, den: Column) -> Column:
    """Reduced, with a positive denominator; a denominator of zero is allowed."""
    sign = F.when(den < 0, -1).otherwise(1)
    div = lambda x, g: F.when(g == 0, x.cast("long")).otherwise(F.call_function("div", x.cast("long"), g)) * sign
    return _euclid(num, den, lambda g: F.struct(div(num, g).alias("num"), div(den, g).alias("den")))


def rational_add(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def rational_sub(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def rational_mul(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["num"], a["den"] * b["den"])


def rational_div(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"], a["den"] * b["num"])


def rational_from_float(x: Column) -> Column:
    return rational(F.round(x * 1_000_000).cast("long"), F.lit(1_000_000))


def to_seconds(ts: Column, num: Column, den: Column) -> Column:
    """A missing time stamp counts as zero."""
    return F.coalesce(ts * num / den, F.lit(0.0))


def from_seconds(seconds: Column, num: Column, den: Column) -> Column:
    return F.round(seconds * den / num).cast("long")


def rescale(ts: Column, num: Column, den: Column, to_num: Column, to_den: Column) -> Column:
    """Exact product, then division that truncates; a missing time stamp stays missing."""
    wide = lambda x: x.cast("decimal(20,0)")
    product = (wide(ts) * wide(num * to_den)).cast("decimal(38,0)")
    return F.call_function("div", product, wide(den * to_num)).cast("long")


def two(x: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    digits = x.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0"))


def smpte_from_frames(frames: Column, fps: int, drop: bool = False) -> Column:
    """``HH:MM:SS:FF``, or ``HH:MM:SS;FF`` with two labels dropped each minute but every tenth; hours count on past a day.

    All divisions are of whole numbers: a double holds no quotient of frames beyond 2 to the power 53.
    """
    label, div = frames.cast("long"), lambda x, size: F.call_function("div", x, F.lit(size))
    if drop:
        minute, ten = fps * 60 - 2, fps * 600 - 18
        tens, rest = div(label, ten), label % ten
        label = label + 18 * tens + F.when(rest >= fps * 60, 2 * (div(rest - fps * 60, minute) + 1)).otherwise(0)
    part = lambda size, most: div(label, size) % most if most else div(label, size)
    return F.concat(two(part(fps * 3600, 0)), F.lit(":"), two(part(fps * 60, 60)), F.lit(":"), two(part(fps, 60)), F.lit(";" if drop else ":"), two(label % fps))


def smpte_parts(text: Column) -> Column:
    """Hours, minutes, seconds and frames of a timecode with colons or semicolons; null if it has other parts."""
    parts = F.split(text, "[:;]")
    return F.when((F.size(parts) == 4) & text.rlike(r"^\d+[:;]\d+[:;]\d+[:;]\d+$"), parts.cast("array<long>"))


def smpte_to_frames(text: Column, fps: int, drop: bool = False) -> Column:
    """The inverse of ``smpte_from_frames``; null for minutes, seconds or frames out of range."""
    p = smpte_parts(text)
    minutes = p[0] * 60 + p[1]
    total = (minutes * 60 + p[2]) * fps + p[3]
    if drop:
        total = total - 2 * (minutes - F.call_function("div", minutes, F.lit(10)))
    return F.when((p[1] < 60) & (p[2] < 60) & (p[3] < fps), total.cast("long"))


def cue_time(text: Column) -> Column:
    """Milliseconds of ``[HH:]MM:SS,mmm`` or ``[HH:]MM:SS.mmm``; null for other text."""
    ok = text.rlike(r"^(\d+:)?\d{1,2}:\d{1,2}[,.]\d{3}$")
    p = F.split(F.trim(text), "[:,.]").cast("array<long>")
    n = F.size(p)
    hours = F.when(n == 4, F.get(p, F.lit(0))).otherwise(0)
    return F.when(ok, ((hours * 60 + F.get(p, n - 3)) * 60 + F.get(p, n - 2)) * 1000 + F.get(p, n - 1))


def clock(ms: Column, comma: str = ",", short: bool = False) -> Column:
    """``HH:MM:SS,mmm``; ``short`` leaves out hours of zero."""
    div = lambda k: F.floor(ms / k)
    tail = F.concat(two(div(60_000) % 60), F.lit(":"), two(div(1000) % 60), F.lit(comma), F.lpad((ms % 1000).cast("string"), 3, "0"))
    full = F.concat(two(div(3_600_000)), F.lit(":"), tail)
    return F.when(div(3_600_000) == 0, tail).otherwise(full) if short else full


def ass_time(text: Column) -> Column:
    """Milliseconds of ``H:MM:SS.cc``."""
    p = F.split(text, "[:.]").cast("array<long>")
    return F.when(text.rlike(r"^\d+:\d{2}:\d{2}\.\d{2}$"), ((p[0] * 60 + p[1]) * 60 + p[2]) * 1000 + p[3] * 10)


def ass_clock(ms: Column) -> Column:
    div = lambda k: F.floor(ms / k)
    return F.concat(div(3_600_000).cast("string"), F.lit(":"), two(div(60_000) % 60), F.lit(":"), two(div(1000) % 60), F.lit("."), two(F.floor((ms % 1000) / 10)))


def bitrate(text: Column) -> Column:
    """Bits a second of ``128k``, ``1.5M``, ``2G`` or a plain number; null for other text."""
    t = F.trim(text)
    unit = F.lower(F.substring(t, -1, 1))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9)
    number = F.when(factor.isNull(), t).otherwise(F.regexp_replace(t, "[kKmMgG]$", ""))
    return (number.try_cast("double") * F.coalesce(factor, F.lit(1.0))).cast("long")


def resolution(text: Column) -> Column:
    """Width and height of ``WxH`` or ``W:H``."""
    p = F.split(F.lower(text), "[x:]").cast("array<int>")
    return F.when(F.lower(text).rlike(r"^\d+[x:]\d+$"), F.struct(p[0].alias("width"), p[1].alias("height")))


def aspect_ratio(ratio: Column) -> Column:
    """The name of a common ratio within 0.01, else thousandths reduced."""
    close = lambda x: F.abs(ratio - x) < 0.01
    r = rational(F.floor(ratio * 1000).cast("long"), F.lit(1000))
    other = F.concat_ws(":", r["num"].cast("string"), r["den"].cast("string"))
    return F.when(close(4 / 3), "4:3").when(close(16 / 9), "16:9").when(close(2.35), "47:20").when(close(1.0), "1:1").otherwise(other)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column) -> Column:
    """Decibels, minus infinity at zero."""
    return F.when(x > 0, 20 * F.log10(F.when(x > 0, x))).otherwise(F.lit(float("-inf")))


def qp_scale(q: Column) -> Column:
    return F.pow(F.lit(2.0), 1 - (F.least(F.greatest(q, F.lit(1)), F.lit(8)) - 1) / 3.5)


#: File extensions of each container format.
FORMATS = {
    "mp4": ["mp4", "m4v", "m4a"],
    "matroska": ["mkv", "mka", "mks"],
    "webm": ["webm"],
    "avi": ["avi"],
    "mov": ["mov"],
    "flv": ["flv"],
    "mpegts": ["ts", "m2ts"],
    "mp3": ["mp3"],
    "ogg": ["ogg", "oga"],
    "wav": ["wav"],
    "flac": ["flac"],
    "opus": ["opus"],
    "y4m": ["y4m", "yuv"],
}


def format_of(path: Column) -> Column:
    """The container format of a path's last extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for name, exts in FORMATS.items() for ext in exts for x in (ext, name)])
    return F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1)))


def magic_format(head: Column) -> Column:
    """The container format that a file's first sixteen bytes show, tested in a fixed order."""
    at = lambda i, n: F.hex(F.substring(head, i + 1, n))
    ascii_at = lambda i, text: at(i, len(text)) == text.encode().hex().upper()
    return (
        F.when(ascii_at(4, "ftyp"), "mp4")
        .when(at(0, 4) == "1A45DFA3", "webm")
        .when(ascii_at(0, "RIFF") & ascii_at(8, "AVI "), "avi")
        .when(ascii_at(0, "RIFF") & ascii_at(8, "WAVE"), "wav")
        .when(ascii_at(0, "OggS"), "ogg")
        .when(ascii_at(0, "fLaC"), "flac")
        .when(ascii_at(0, "ID3") | at(0, 2).isin("FFFB", "FFF3", "FFF2"), "mp3")
        .when(ascii_at(0, "YUV4MPEG2"), "y4m")
        .otherwise("unknown")
    )
