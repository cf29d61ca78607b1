"""Whole-document writers and readers: ASS, FCPXML-like timelines, DASH manifests, pass statistics, command lines."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ass_clock
from .control import _joined

ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,20\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"


def ass_track(cues: DataFrame) -> DataFrame:
    """One default style, and a Dialogue line for each cue; line breaks become ``\\N``."""
    text = F.regexp_replace("text", "\n", r"\\N")
    line = F.concat(F.lit("Dialogue: 0,"), ass_clock(F.col("start_ms")), F.lit(","), ass_clock(F.col("end_ms")), F.lit(",Default,"), text)
    return _joined(cues.select("track", "ordinal", line.alias("b")), "\n", ASS_HEAD, "\n")


def xml_timeline(events: DataFrame, name: str, fps: int = 25) -> DataFrame:
    """A simplified version-5 interchange document with a clip for each event."""
    frame = lambda c: F.floor(F.col(c) * fps / 1000).cast("string")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("reel", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    clip = F.concat(F.lit("<clipitem><name>"), escaped, F.lit("</name><start>"), frame("start_ms"), F.lit("</start><end>"), frame("end_ms"), F.lit("</end></clipitem>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<xmeml version="5"><sequence><name>{name}</name><rate><timebase>{fps}</timebase></rate><media><video><track>\n'
    return _joined(events.select("track", "ordinal", clip.alias("b")), "\n", head, "\n</track></video></media></sequence></xmeml>\n")


def dash_manifest(segments: DataFrame, profiles: list[tuple[str, int, int, int]]) -> DataFrame:
    """A static manifest for each stream: every segment under every profile (name, bits, width, height)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", F.col("duration").alias("d")))), lambda s: F.format_string('<SegmentURL media="segment_%05d.m4s" duration="%d"/>', s["segment"], s["d"]))
    made = segments.groupBy("stream").agg(F.array_join(parts, "").alias("urls"), F.sum("duration").alias("total"))
    sets = [F.concat(F.lit(f'<Representation id="{n}" bandwidth="{b}" width="{w}" height="{h}"><SegmentList>'), "urls", F.lit("</SegmentList></Representation>")) for n, b, w, h in profiles]
    head = F.format_string('<?xml version="1.0"?>\n<MPD type="static" mediaPresentationDuration="PT%.3fS"><Period><AdaptationSet>', F.col("total") / 1000.0)
    return made.select("stream", F.concat(head, *sets, F.lit("</AdaptationSet></Period></MPD>\n")).alias("manifest"))


def statistics_json(stats: DataFrame) -> DataFrame:
    """A JSON document of the frame statistics of each stream."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "kind", "bits", "complexity", "motion")))
    return stats.groupBy("stream").agg(F.to_json(F.struct(rows.alias("frames"))).alias("document"))


def read_statistics_json(documents: DataFrame) -> DataFrame:
    """The frame statistics of such documents; a broken document gives no rows."""
    kind = "frames array<struct<idx:bigint,kind:string,bits:bigint,complexity:bigint,motion:bigint>>"
    return documents.select("stream", F.inline(F.from_json("document", kind)["frames"]))


#: Command-line options that take no value, and names of those that do.
FLAGS = {"-y": "overwrite", "-n": "keep", "-an": "no_audio", "-vn": "no_video", "-sn": "no_subtitles", "-shortest": "shortest"}
#: What each option with a value sets.
SETS = {
    "input": "-i", "output": "-o", "video_codec": "-c:v -vcodec -codec:v", "audio_codec": "-c:a -acodec -codec:a", "video_bitrate": "-b:v -vb", "audio_bitrate": "-b:a -ab", "size": "-s -video_size",
    "frame_rate": "-r -framerate", "pixel_format": "-pix_fmt", "crf": "-crf", "preset": "-preset", "pass": "-pass", "sample_rate": "-ar", "channels": "-ac", "start": "-ss", "duration": "-t", "end": "-to",
    "hardware": "-hwaccel", "quality": "-quality", "profile": "-profile:v -profile", "level": "-level -level:v", "tune": "-tune", "gop": "-g", "b_frames": "-bf", "max_bitrate": "-maxrate", "buffer_size": "-bufsize",
    "threads": "-threads", "filter_graph": "-filter_complex -lavfi", "video_filter": "-vf -filter:v", "audio_filter": "-af -filter:a", "format": "-f", "map": "-map",
}
VALUES = {option: name for name, options in SETS.items() for option in options.split()}


@dataclass
class Job:
    inputs: list[str] = field(default_factory=list)
    output: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    extra: list[str] = field(default_factory=list)

    def seconds(self) -> float | None:
        """Length of the cut: the duration, else the end less the start, else the end."""
        at = {k: clock_seconds(self.params[k]) for k in ("start", "end", "duration") if k in self.params}
        if "duration" in at:
            return at["duration"]
        return at["end"] - at.get("start", 0.0) if "end" in at else None


def clock_seconds(text: str) -> float:
    """Seconds of ``[[HH:]MM:]SS[.mmm]``."""
    total = 0.0
    for part in text.split(":"):
        total = total * 60 + float(part)
    return total


def parse_command(line: str) -> Job:
    """A transcode job from a command line; unknown options are kept, the first bare word is the output."""
    job, words = Job(), shlex.split(line)
    at = 0
    while at < len(words):
        word, after = words[at], words[at + 1] if at + 1 < len(words) else None
        at += 1
        if word in FLAGS:
            job.params[FLAGS[word]] = "true"
        elif word in ("-c", "-codec") and after == "copy":
            job.params["video_codec"] = job.params["audio_codec"] = "copy"
            at += 1
        elif word in VALUES:
            if after is None:
                raise ValueError(f"{word} needs a value")
            at += 1
            if word == "-i":
                job.inputs.append(after)
            elif word == "-o":
                job.output = after
            else:
                job.params[VALUES[word]] = after
        elif word.startswith("-") and len(word) > 1:
            job.extra.append(word)
        elif job.output is None and word != "ffmpeg":
            job.output = word
        elif word != "ffmpeg":
            job.extra.append(word)
    return job


COMMAND = "inputs array<string>, output string, params map<string,string>, extra array<string>, seconds double, error string"


def parse_commands(lines: Column) -> Column:
    """The same for a column of command lines: a struct of what each says; what cannot be read has an ``error`` and nothing else."""

    @F.pandas_udf(COMMAND)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                job = parse_command(text) if text is not None else Job()
                rows.append((job.inputs, job.output, job.params, job.extra, job.seconds(), None))
            except ValueError as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COMMAND.split(", ")])

    return run(lines)
