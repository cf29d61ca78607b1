"""Subtitle readers: cues of SubRip, WebVTT and ASS texts, a text per row, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ass_time, cue_time


def _cues(blocks: DataFrame, key: str, lenient: bool) -> DataFrame:
    """Cues of blocks with a line of ``times``; what has no valid times is left out, or an error."""
    times = F.split("times", r"\s+")
    start, end = cue_time(times[0]), cue_time(F.get(times, F.lit(2)))
    bad = start.isNull() | end.isNull() | (F.get(times, F.lit(1)) != "-->")
    if lenient:
        return blocks.filter(~F.coalesce(bad, F.lit(True))).select(key, "ordinal", start.alias("start_ms"), end.alias("end_ms"), "text")
    error = F.raise_error(F.concat(F.lit("no valid cue: "), F.coalesce("times", F.lit("no times")))).cast("bigint")
    return blocks.select(key, "ordinal", F.when(F.coalesce(bad, F.lit(True)), error).otherwise(start).alias("start_ms"), end.alias("end_ms"), "text")


def _blocks(texts: DataFrame, key: str, body: Column, between: str = "") -> DataFrame:
    """Blank-line separated blocks as arrays of lines; line ends of other systems are normalised."""
    whole = F.regexp_replace(body, "\r\n?", "\n")
    rows = texts.select(key, F.posexplode(F.split(whole, rf"\n\s*\n{between}")).alias("ordinal", "block"))
    return rows.select(key, "ordinal", F.split(F.regexp_replace("block", r"^\s*\n|^\s+|\s+$", ""), "\n").alias("lines")).filter("lines[0] <> ''")


def _from(lines: Column, place: Column) -> Column:
    return F.array_join(F.slice(lines, place, F.greatest(F.size(lines) - place + 1, F.lit(0))), "\n")


def parse_srt(texts: DataFrame, key: str, text: str, lenient: bool = True) -> DataFrame:
    """``key, ordinal, start_ms, end_ms, text`` of each cue.

    A strict reader fails on a text with a block without a number or valid times.  A lenient one looks at no numbers and
    leaves out blocks of fewer than three lines or without valid times.
    """
    lines = F.col("lines")
    rows = _blocks(texts, key, F.col(text))
    if lenient:
        rows = rows.filter(F.size("lines") >= 3)
    numbered = F.lit(True) if lenient else lines[0].rlike(r"^\s*\d+\s*$")
    return _cues(rows.select(key, "ordinal", F.when(numbered, F.trim(F.get(lines, F.lit(1)))).alias("times"), _from(lines, F.lit(3)).alias("text")), key, lenient)


def parse_vtt(texts: DataFrame, key: str, text: str, lenient: bool = False) -> DataFrame:
    """Cues of WebVTT texts; cue settings are dropped.

    A strict reader fails on a text without the WEBVTT head or with a block without valid times; a line ahead of the
    times is the cue's id, and a line that begins with NOTE ends a cue's text and begins the next block.  A lenient one
    takes only blocks whose first line has times and another follows.
    """
    lines = F.col("lines")
    whole = F.regexp_replace(F.col(text), "\r\n?", "\n")
    if lenient:
        rows = _blocks(texts, key, F.regexp_replace(whole, r"^(WEBVTT)*\s*", "")).filter(F.size("lines") > 1)
        return _cues(rows.select(key, "ordinal", F.trim(lines[0]).alias("times"), _from(lines, F.lit(2)).alias("text")), key, True)
    headed = F.when(whole.startswith("WEBVTT"), F.regexp_replace(whole, r"^WEBVTT[^\n]*(\n(?![^\n]*-->)[^\n]+)*\n*", "")).otherwise(F.raise_error(F.lit("no WEBVTT head")).cast("string"))
    rows = _blocks(texts, key, headed, r"|\n(?=NOTE)").withColumn("_at", F.when(lines[0].contains("-->"), 1).otherwise(2))
    return _cues(rows.select(key, "ordinal", F.trim(F.get(lines, F.col("_at") - 1)).alias("times"), _from(lines, F.col("_at") + 1).alias("text")), key, False)


def parse_ass(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Dialogue lines of the Events section; its Format line names the columns, the text keeps its commas."""
    body = F.regexp_replace(F.col(text), "\r\n?", "\n")
    events = F.regexp_extract(body, r"(?s)\[Events\]\n(.*?)(?:\n\[|$)", 1)
    rows = texts.select(key, F.split(events, "\n").alias("lines"))
    names = F.transform(F.split(F.regexp_replace(F.element_at(F.filter("lines", lambda x: x.startswith("Format:")), 1), "^Format:", ""), ","), lambda x: F.trim(x))
    rows = rows.select(key, names.alias("names"), F.posexplode(F.filter("lines", lambda x: x.startswith("Dialogue:"))).alias("ordinal", "line"))
    n = F.size("names")
    fields = F.transform(F.expr("split(substring(line, 10), ',', size(names))"), lambda x, i: F.when(i < n - 1, F.trim(x)).otherwise(F.ltrim(x)))
    rows = rows.withColumn("fields", fields).filter(F.size("fields") == n)
    field = lambda name: F.get("fields", (F.array_position("names", F.lit(name)) - 1).cast("int"))
    out = rows.select(key, "ordinal", ass_time(field("Start")).alias("start_ms"), ass_time(field("End")).alias("end_ms"), field("Style").alias("style"), field("Text").alias("text"))
    return out.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL")
