"""Sources, sinks, streams and rules that the SQL counterparts do not reach."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from cinelake.functions import scalars
from cinelake.operators import audio, control, islands, pixels
from cinelake.sources import cube, media, sinks, subtitles
from cinelake.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def packets(spark, rows):
    return spark.createDataFrame(rows, "file string, stream_index int, seq long, pts long, dts long, keyframe boolean, data binary")


def test_wav_round_trip(spark, tmp_path):
    tone = [int(16000 * math.sin(i / 5)) for i in range(250)]
    raw = b"".join(struct.pack("<hh", v, -v) for v in tone)
    cut = [raw[:400], raw[400:800], raw[800:]]
    rows = [(f"{name}.wav", 0, i, i * 100, i * 100, True, bytearray(d)) for name in "ab" for i, d in enumerate(cut)]
    sinks.write(packets(spark, rows).repartition(5), str(tmp_path), "wav", rate="100", channels="2")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
    path = str(tmp_path / "a.wav")
    got = media.read_media(spark, path, packets_per_partition="2").orderBy("seq").collect()
    assert [r.pts for r in got] == [0, 100, 200] and [r.duration for r in got] == [100, 100, 50]
    assert b"".join(bytes(r.data) for r in got) == raw and all(r.keyframe for r in got)
    header = media.wav_header(path)
    assert (header.channels, header.rate, header.bits, header.data_size) == (2, 100, 16, len(raw))
    assert media.read_media(spark, str(tmp_path / "*.wav")).count() == 6
    assert media.read_media(spark, f"file://{path}").count() == 3
    assert media.read_media(spark, path).filter("seq = 1").select("pts", "position").collect() == [(100, 44 + 400)]


def test_y4m_round_trip(spark, tmp_path):
    path = str(tmp_path / "c.y4m")
    frames = [bytes((i + k) % 256 for k in range(media.y4m_frame_size(6, 4, "420"))) for i in range(5)]
    sinks.write(packets(spark, [("c.y4m", 0, i, i, i, False, bytearray(d)) for i, d in enumerate(frames)]), str(tmp_path), "y4m", width="6", height="4")
    rows = media.read_media(spark, path, packets_per_partition="2").orderBy("seq").collect()
    assert [bytes(r.data) for r in rows] == frames and not any(r.keyframe for r in rows)
    with pytest.raises(Exception, match="1 bytes"):
        sinks.write(packets(spark, [("d.y4m", 0, 0, 0, 0, False, bytearray(b"x"))]), str(tmp_path), "y4m", width="6", height="4")
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".part")] == ["c.y4m"]
    assert [media.y4m_frame_size(4, 4, c) for c in ("420", "422", "444", "mono", "420p10")] == [24, 32, 48, 16, 48]


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        media.read_media(spark, "x.flv")


def test_cube(spark):
    rows = [(r / 2, g / 2, b / 2) for b in range(3) for g in range(3) for r in range(3)]
    made = cube.parse_cube(cube.format_cube(cube.Cube(3, rows, "same")))
    assert made.title == "same" and made.rows == rows
    got = one(spark, cube.apply_cube(made, F.lit(0.3), F.lit(0.9), F.lit(2.0)))
    assert got == pytest.approx([0.3, 0.9, 1.0])
    with pytest.raises(ValueError):
        cube.parse_cube("LUT_3D_SIZE 2\n0 0 0\n")


def test_subtitle_readers(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\nfirst\r\nline\r\n\r\nbroken\n\n2\n00:01:00,000 --> 01:00:00,000\nsecond\n"
    vtt = "WEBVTT\n\nid\n00:01.000 --> 00:02.000 align:start\nhello\n\n01:00:00.500 --> 01:00:01.000\nworld\n"
    ass = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.50,0:00:02.00,Main,a, b\nDialogue: bad\n"
    rows = spark.createDataFrame([(1, srt, vtt, ass)], "k int, srt string, vtt string, ass string")
    got = subtitles.parse_srt(rows, "k", "srt").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text.strip()) for r in got] == [(1000, 2500, "first\nline"), (60000, 3600000, "second")]
    got = subtitles.parse_vtt(rows, "k", "vtt").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text.strip()) for r in got] == [(1000, 2000, "hello"), (3600500, 3601000, "world")]
    with pytest.raises(Exception, match="no valid cue"):
        subtitles.parse_srt(rows, "k", "srt", lenient=False).collect()
    good = rows.withColumn("srt", F.lit("7\n00:00:01,000 --> 00:00:02,500\nfirst\nline\n\n8\n00:00:03,000 --> 00:00:04,000\n"))
    assert [(r.start_ms, r.text) for r in subtitles.parse_srt(good, "k", "srt", lenient=False).orderBy("start_ms").collect()] == [(1000, "first\nline"), (3000, "")]
    assert subtitles.parse_srt(good, "k", "srt").count() == 1  # a block needs a line of text
    note = "WEBVTT - a title\nKind: captions\n\n00:01.000 --> 00:02.000\nhello\nNOTE 5\n00:03.000 --> 00:04.000\nafter\n"
    noted = spark.createDataFrame([(1, note)], "k int, vtt string")
    assert [(r.start_ms, r.text) for r in subtitles.parse_vtt(noted, "k", "vtt").orderBy("start_ms").collect()] == [(1000, "hello"), (3000, "after")]
    with pytest.raises(Exception, match="no valid cue"):
        subtitles.parse_vtt(noted.withColumn("vtt", F.lit("WEBVTT\n\nNOTE this is a comment\n")), "k", "vtt").collect()
    with pytest.raises(Exception, match="no WEBVTT head"):
        subtitles.parse_vtt(noted.withColumn("vtt", F.lit("00:01.000 --> 00:02.000\nhello\n")), "k", "vtt").collect()
    loose = subtitles.parse_vtt(rows, "k", "vtt", lenient=True).collect()
    assert [(r.start_ms, r.text) for r in loose] == [(3600500, "world")]  # the block with an id is left out
    got = subtitles.parse_ass(rows, "k", "ass").collect()
    assert [(r.start_ms, r.end_ms, r.style, r.text) for r in got] == [(1500, 2000, "Main", "a, b")]


def test_timecodes(spark):
    assert one(spark, scalars.smpte_from_frames(F.lit(1800), 30, drop=True)) == "00:01:00;02"
    assert one(spark, scalars.smpte_from_frames(F.lit(17982), 30, drop=True)) == "00:10:00;00"
    assert one(spark, scalars.smpte_to_frames(F.lit("00:01:00;02"), 30, drop=True)) == 1800
    assert one(spark, scalars.smpte_to_frames(F.lit("00:61:00:02"), 30)) is None
    assert one(spark, scalars.smpte_to_frames(F.lit("nonsense"), 30)) is None


def test_scalar_edges(spark):
    assert one(spark, scalars.rational(F.lit(6), F.lit(-4))).asDict() == {"num": -3, "den": 2}
    assert one(spark, scalars.rational(F.lit(6), F.lit(0))).asDict() == {"num": 1, "den": 0}
    assert one(spark, scalars.to_seconds(F.lit(None).cast("long"), F.lit(1), F.lit(1000))) == 0.0
    assert one(spark, scalars.rescale(F.lit(-7), F.lit(1), F.lit(2), F.lit(1), F.lit(1))) == -3
    assert one(spark, scalars.rescale(F.lit(1000), F.lit(1), F.lit(1000), F.lit(1), F.lit(90000))) == 90000
    assert one(spark, scalars.bitrate(F.lit(" 1.5M"))) == 1_500_000 and one(spark, scalars.bitrate(F.lit("fast"))) is None
    assert one(spark, scalars.linear_to_db(F.lit(0.0))) == float("-inf")
    assert one(spark, scalars.cue_time(F.lit("x"))) is None


def test_silence_fixture(spark):
    rows = spark.range(3000).select(F.lit(0).alias("stream"), F.col("id").alias("i"), F.when(F.col("id") < 2000, 30).otherwise(16000).alias("x"))
    assert audio.silence(rows, 327, 1000).collect() == [(0, 0, 2000)]
    assert audio.rms_silence(rows.filter("i < 2000"), 100, 327, 2).collect() == []  # lasts to the end


def test_planes(spark):
    frames = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [0, 1, 2, 3])], "frame_no long, p array<int>")
    assert pixels.rotate(frames, 2, 2, 90).first().p == [2, 0, 3, 1]
    assert pixels.flip(frames, 2, 2, horizontal=False, vertical=True).first().p == [2, 3, 0, 1]
    with pytest.raises(ValueError):
        pixels.crop(frames, 2, 1, 0, 2, 1)
    same = pixels.following(frames).filter("q IS NOT NULL").select(pixels.psnr(pixels.mse()).alias("x"))
    assert same.first().x == float("inf")
    assert one(spark, pixels.psnr(F.lit(100.0))) == pytest.approx(28.1308, abs=1e-3)


def test_following_crosses_blocks(spark):
    frames = spark.range(10).select(F.col("id").alias("frame_no"), F.array(F.col("id").cast("int")).alias("p"))
    got = {r.frame_no: r.q for r in pixels.following(frames, block=3).collect()}
    assert got == {0: None, **{i: [i - 1] for i in range(1, 10)}}


def test_segmenter_fixture(spark):
    packets = spark.range(20).select(F.lit(0).alias("stream"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("pts"), F.lit(100).cast("long").alias("size"), (F.col("id") % 5 == 0).alias("keyframe"))
    rows = control.segments(packets, 6000, 12000).orderBy("segment").collect()
    assert [(r.start, r.duration, r.packets) for r in rows] == [(0, 9000, 10), (10000, 9000, 10)]


def test_asof_join_is_inclusive(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 3, "a")], "k int, t int, v string")
    got = {(r.k, r.t): (r.right_t, r.right_v) for r in islands.asof_join(left, right, "k", "t", "v").collect()}
    assert got == {(1, 5): (5, "b"), (1, 0): (None, None), (2, 9): (None, None)}


def stream_to_rows(spark, frame, tmp_path, build, mode):
    source = str(tmp_path / "in")
    frame.repartition(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out_{mode}_{frame.columns[0]}"
    query = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streaming_segmenter_equals_batch(spark, tmp_path):
    packets = spark.range(40).select((F.col("id") % 2).alias("stream"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("pts"), F.lit(10).cast("long").alias("size"), (F.col("id") % 6 < 2).alias("keyframe"))
    got = stream_to_rows(spark, packets, tmp_path, lambda s: stateful.stream_segments(s, 6000, 12000), "append")
    whole = control.segments(packets, 6000, 12000)
    closed = whole.join(whole.groupBy("stream").agg(F.max("segment").alias("open")), "stream").filter("segment < open").drop("open")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_job_states_stop_at_a_terminal_one(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "running", 0.5), (1, 2, "complete", 0.9), (1, 3, "running", 0.1), (2, 1, "running", 0.2)], "job_id long, ts long, kind string, progress double")
    rows = stream_to_rows(spark, events, tmp_path, stateful.job_states, "update").collect()
    assert sorted(map(tuple, rows)) == [(1, "complete", 1.0, 2), (2, "running", 0.2, 1)]
