"""The queue's log, feeds and packages for adaptive streaming."""

import random

import pytest
from pyspark.sql import functions as F

from cinelake.operators import queue
from cinelake.sources import containers, packages
from tests.test_media import stream_to_rows

EVENTS = "queue long, seq long, ts long, kind string, job_id long, worker_id long, value double"


def log(spark, *events, number=0):
    return spark.createDataFrame([(number, n, *e) for n, e in enumerate(events)], EVENTS)


def test_protocol(spark):
    events = [
        (0, "register", None, 1, None), (0, "heartbeat", None, 2, None), (1, "enqueue", 10, None, None), (1, "enqueue", 11, None, None), (1, "enqueue", 12, None, None),
        (2, "start", 10, 1, None), (2, "enqueue", 12, None, None), (3, "progress", 10, 1, 0.5), (3, "progress", 11, 1, 0.5), (9, "heartbeat", None, 1, None), (10, "check", None, None, None),
        (20, "check", None, None, None), (21, "start", 10, 1, None), (22, "register", None, 1, None), (23, "start", 10, 1, None), (24, "complete", 10, 1, None), (25, "cancel", 10, None, None),
        (25, "cancel", 11, None, None), (26, "start", 11, 1, None), (27, "dance", 11, 1, None),
    ]
    got = [(r.accepted, r.note, r.depth) for r in queue.outcomes(log(spark, *events), 2, 10).orderBy("seq").collect()]
    assert got == [
        (True, "online", 0), (False, "unknown worker", 0), (True, "queued", 1), (True, "queued", 2), (False, "queue is full", 2),
        (True, "running", 1), (True, "queued", 2), (True, "running", 2), (False, "not running", 2), (True, "", 2), (True, "", 2),
        (True, "10", 3), (False, "cannot start", 3), (True, "online", 3), (True, "running", 2), (True, "complete", 2), (False, "done or unknown", 2),
        (True, "cancelled", 1), (False, "cannot start", 1), (False, "unknown kind", 1),
    ]


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    kinds = ["register", "heartbeat", "enqueue", "enqueue", "start", "start", "progress", "complete", "fail", "cancel", "check"]
    rows = [(q, n, n, rnd.choice(kinds), rnd.randint(0, 9), rnd.randint(0, 2), rnd.random()) for q in range(3) for n in range(120)]
    table = spark.createDataFrame(rows, EVENTS)
    got = stream_to_rows(spark, table, tmp_path, lambda s: queue.stream_outcomes(s, 4, 15), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queue.outcomes(table, 4, 15).collect()))


def test_feed_ends_with_a_terminal_state(spark):
    jobs = spark.createDataFrame([(1, "running", 5), (2, "complete", 5), (3, "queued", 0)], "job_id long, state string, seq long")
    updates = spark.createDataFrame([(1, 4, "running", 0.1), (1, 6, "running", 0.6), (1, 7, "complete", 1.0), (1, 8, "running", 0.9), (2, 9, "running", 0.5), (3, 2, "running", 0.2)], "job_id long, seq long, state string, progress double")
    got = sorted(map(tuple, queue.progress_feed(jobs, updates).collect()), key=str)
    assert got == sorted([(1, 5, "running", None), (1, 6, "running", 0.6), (1, 7, "complete", 1.0), (2, 5, "complete", None), (3, 0, "queued", None), (3, 2, "running", 0.2)], key=str)


def test_latency_of_the_last(spark):
    rows = spark.range(20).select(F.lit(1).alias("stream"), F.col("id").alias("seq"), F.col("id").alias("sent"), (F.col("id") * 2).alias("done"))
    assert queue.latency_window(rows, 4).collect() == [(1, 4, pytest.approx(17.5), 19)]


def packets(spark):
    rows = [(s, i, i * 1000, i * 1000, i % 5 == 0, 0, 100, bytearray(b"\0\0\0\1" + (b"\x65" if i % 5 == 0 else b"\x41") + bytes([s + 1, i + 1] * 40))) for s in range(2) for i in range(20)]
    return spark.createDataFrame(rows, "stream long, seq long, pts long, dts long, keyframe boolean, stream_index int, size long, data binary")


def test_hls_package(spark, tmp_path):
    profiles = spark.createDataFrame([(0, "low", 160, 90, 1000)], "ordinal int, name string, width int, height int, bits int")
    made = packages.hls_package(packets(spark), str(tmp_path), 6000, 12000, profiles)
    assert sorted(r.path for r in made.collect()) == ["0/media.m3u8", "1/media.m3u8", "master.m3u8"]
    listed = [x for x in (tmp_path / "1" / "media.m3u8").read_text().split("\n") if x.endswith(".ts")]
    assert listed == ["segment_00000.ts", "segment_00001.ts"]
    got = [p for name in listed for p in containers.parse_ts((tmp_path / "1" / name).read_bytes())]
    assert [(p.pts, p.data[5:7]) for p in got] == [(i * 1000, bytes([2, i + 1])) for i in range(20)]
    assert "low.m3u8" in (tmp_path / "master.m3u8").read_text()


def test_dash_package(spark, tmp_path):
    made = packages.dash_package(packets(spark), str(tmp_path), 6000, 12000, [("a", 100, 16, 9)])
    assert sorted(r.path for r in made.collect()) == ["0/manifest.mpd", "1/manifest.mpd"]
    assert (tmp_path / "0" / "segment_00001.m4s").read_bytes()[4:8] == b"ftyp"
    assert "segment_00001.m4s" in (tmp_path / "0" / "manifest.mpd").read_text()
