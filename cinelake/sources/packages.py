"""Packages for adaptive streaming: segment files, their playlists and manifests, written under one folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control, documents
from . import sinks
from .files import move, open_output


def write_documents(table: DataFrame, folder: str, path: str = "path", body: str = "body") -> DataFrame:
    """Write each row's body to its path below the folder; returns ``path, bytes``, a row per document.

    A file appears under its name when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, target = text.encode(), f"{folder}/{name}"
                with open_output(f"{target}.part") as f:
                    f.write(raw)
                move(f"{target}.part", target)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    made = table.select(F.col(path).alias("path"), F.col(body).alias("body")).mapInArrow(run, "path string, bytes long").persist()
    made.count()  # they are written now, and the rows stay where they were made
    return made


def with_segments(packets: DataFrame, numbers: DataFrame, name: str = "%d/segment_%05d.ts") -> DataFrame:
    """Packets with the ``file`` of their segment, by the number that the segmenter gave to their ``seq``."""
    own = numbers.select(F.col("stream").alias("_stream"), F.col("seq").alias("_seq"), F.col("segment").alias("_n"))
    placed = packets.join(own, (F.col("stream") == F.col("_stream")) & (F.col("seq") == F.col("_seq")))
    return placed.withColumn("file", F.format_string(name, "_stream", "_n")).drop("_stream", "_seq", "_n")


def hls_package(packets: DataFrame, folder: str, target: int, most: int, profiles: DataFrame, kind: str = "ts", **options: str) -> DataFrame:
    """Segment files, a media playlist for each stream, and a master playlist of the profiles; returns the documents.

    ``packets``: ``stream, seq, pts, size, keyframe`` and what the sink of ``kind`` takes; a stream's ``seq`` are unique.  Packets
    are segmented once, without their bytes, in the order of ``seq``, whatever the order of their times.
    """
    numbers = control.segment_numbers(packets, target, most).persist()
    sinks.write(with_segments(packets, numbers), folder, kind, **options)
    media = control.media_playlist(control.segments_of(numbers), target // 1000).select(F.format_string("%d/media.m3u8", "stream").alias("path"), F.col("playlist").alias("body"))
    master = control.master_playlist(profiles).select(F.lit("master.m3u8").alias("path"), F.col("playlist").alias("body"))
    made = write_documents(media.unionByName(master), folder)
    numbers.unpersist()
    return made


def dash_package(packets: DataFrame, folder: str, target: int, most: int, profiles: list[tuple[str, int, int, int]], kind: str = "mp4", **options: str) -> DataFrame:
    """Segment files and a manifest for each stream; returns the documents."""
    numbers = control.segment_numbers(packets, target, most).persist()
    sinks.write(with_segments(packets, numbers, "%d/segment_%05d.m4s"), folder, kind, **options)
    made = documents.dash_manifest(control.segments_of(numbers), profiles)
    made = write_documents(made.select(F.format_string("%d/manifest.mpd", "stream").alias("path"), F.col("manifest").alias("body")), folder)
    numbers.unpersist()
    return made
