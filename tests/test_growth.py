"""What holds on small tables must hold on larger ones: rows of a key in one task, numbers beyond two digits."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions import scalars
from cinelake.operators import control, neighbours, sync
from cinelake.plans import control_queries, views
from cinelake.sources import media, sinks


@pytest.fixture
def joined_up(spark):
    """Partitions of a shuffle are joined up to a size that the sides of a union reach at different places."""
    adaptive = {"advisoryPartitionSizeInBytes": "16k", "coalescePartitions.minPartitionSize": "1k", "coalescePartitions.parallelismFirst": "false"}
    for name, value in adaptive.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for name in adaptive:
        spark.conf.unset(f"spark.sql.adaptive.{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def numbered(spark, streams, each):
    rows = spark.range(streams * each).select((F.col("id") % streams).alias("stream"), "id", (F.xxhash64("id") % 100).cast("int").alias("x"))
    return rows.select("stream", (F.row_number().over(W.partitionBy("stream").orderBy("id")) - 1).cast("long").alias("i"), "x")


def later(rows):
    return rows.select("stream", (F.col("i") + 3).alias("i"), "x").unionByName(rows.filter("i < 3").select("stream", "i", F.lit(0).alias("x")))


def test_every_lag_of_every_stream(spark, joined_up):
    rows = numbered(spark, 400, 30)
    got = sync.lag_scores(rows, later(rows), 20).groupBy("lag").agg(F.count("*").alias("n")).collect()
    assert {r.lag: r.n for r in got} == {k: 400 for k in range(13)}


def test_every_stream_has_an_offset(spark, joined_up):
    rows = numbered(spark, 400, 30)
    got = sync.sync_offset(rows, later(rows), 20).groupBy("offset").agg(F.count("*").alias("n"), F.min("confidence").alias("c")).collect()
    assert [(r.offset, r.n, round(r.c, 6)) for r in got] == [(3, 400, 1.0)]


def test_short_streams_have_no_offset(spark):
    rows = numbered(spark, 1, 30).filter("i < 18").unionByName(numbered(spark, 1, 30).select(F.lit(1).cast("long").alias("stream"), "i", "x"))
    rows = rows.unionByName(rows.select(F.lit(None).cast("long").alias("stream"), "i", "x").filter("i < 25"))
    lags = {r.stream: r.n for r in sync.lag_scores(rows, later(rows), 20, least=20).groupBy("stream").agg(F.count("*").alias("n")).collect()}
    assert lags == {0: 1, 1: 13}  # 21 and 33 samples are searched by their lags with 20 to follow
    assert [(r.stream, r.offset) for r in sync.sync_offset(rows, later(rows), 20, least=20).orderBy("stream").collect()] == [(0, 0), (1, 3)]
    assert sync.sync_offset(rows.filter("i < 17"), later(rows.filter("i < 17")), 20, least=20).count() == 0


def test_timecodes_beyond_a_day(spark):
    frames = [30 * 3600 * h + f for h in (23, 24, 99, 100, 1000) for f in (0, 1799, 1800, 1801)]
    rows = spark.createDataFrame([(n,) for n in frames], "n long")
    rows = rows.select("n", scalars.smpte_from_frames(F.col("n"), 25).alias("plain"), scalars.smpte_from_frames(F.col("n"), 30, drop=True).alias("dropped"))
    got = rows.select("*", scalars.smpte_to_frames(F.col("dropped"), 30, drop=True).alias("back")).collect()
    assert [r.back for r in got] == frames
    assert [r.plain for r in got] == [f"{n // 90000:02d}:{n // 1500 % 60:02d}:{n // 25 % 60:02d}:{n % 25:02d}" for n in frames]


def test_frames_added_to_late_timecodes(spark):
    rows = spark.createDataFrame([("23:59:59:24",), ("24:00:00:00",), ("246:40:00:07",), ("24:60:00:00",)], "code string")
    got = [r.n for r in rows.select((scalars.smpte_to_frames(F.col("code"), 25) - 5000).alias("n")).collect()]
    assert got == [2_154_999, 2_155_000, 22_195_007, None]


def test_timecodes_of_very_large_frame_numbers(spark):
    frames = [25 * 3600 * 1000 * 5**k + f for k in range(12, 16) for f in (-1, 0, 1)] + [2**62 - 1, 2**62]
    rows = spark.createDataFrame([(n,) for n in frames], "n long")
    for fps, drop in ((25, False), (30, True)):
        code = scalars.smpte_from_frames(F.col("n"), fps, drop)
        assert [r.back for r in rows.select(scalars.smpte_to_frames(code, fps, drop).alias("back")).collect()] == frames
    plain = [r.code for r in rows.select(scalars.smpte_from_frames(F.col("n"), 25).alias("code")).collect()]
    assert plain == [f"{n // 90000:02d}:{n // 1500 % 60:02d}:{n // 25 % 60:02d}:{n % 25:02d}" for n in frames]


@pytest.fixture
def lines(spark, tmp_path):
    rows = spark.range(400).withColumn("h", F.abs(F.xxhash64("id")))
    rows = rows.selectExpr("id % 37 l_orderkey", "h % 7 + 1 l_linenumber", "id l_partkey", "h % 5 l_suppkey", "h % 900 / 4 l_extendedprice", "h % 50 * 1.0D l_quantity", "h % 11 / 100D l_discount", "substring('ANR', int(h % 3) + 1, 1) l_returnflag")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def passes(made):
    plan = made._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Sort [")


def test_look_ahead_is_one_sort(spark, lines):
    made = control_queries.look_ahead_bitrate(spark, lines)
    assert passes(made) == (1, 1)
    want = control.look_ahead_bitrate(views.frame_stats(spark, lines), 3, 1000).select("stream", "idx", F.round("budget", 8).alias("budget"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and made.count() == 400


def test_frame_windows_share_a_sort(spark, lines):
    for made in (control_queries.motion_average, control_queries.frame_quantizer, control_queries.stabilization_stats):
        assert passes(made(spark, lines)) == (1, 1), made.__name__


def test_divisors_in_one_short_fold(spark):
    fibonacci = [1, 1]
    while len(fibonacci) < 91:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    pairs = [*zip(fibonacci, fibonacci[1:], strict=False), *zip(fibonacci[1:], fibonacci, strict=False), (0, 0), (0, 7), (-12, 18), (12, -18), (2**63 - 1, 2**63 - 1), (2**62, 6), (5, 0)]
    made = scalars.rational(F.col("a"), F.col("b"))
    assert str(made).count("aggregate(") == 1
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", scalars.gcd(F.col("a"), F.col("b")).alias("g"), made.alias("r")).collect()
    for r in rows:
        g, sign = math.gcd(r.a, r.b), -1 if r.b < 0 else 1
        assert r.g == g and tuple(r.r) == (r.a // (g or 1) * sign, r.b // (g or 1) * sign)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    rows = numbered(spark, 300, 40).groupBy("stream", F.expr("i div 16").alias("seq")).agg(F.unhex(F.lpad(F.hex(F.count("*")), 2, "0")).alias("data"))
    packets = rows.select(F.format_string("%d.wav", "stream").alias("file"), F.lit(0).alias("stream_index"), "seq", F.col("seq").alias("pts"), F.col("seq").alias("dts"), F.lit(True).alias("keyframe"), "data")
    sinks.write(packets, str(tmp_path), "wav", rate="1", bits="8")
    back = media.read_media(spark, f"{tmp_path}/*.wav")
    assert back.rdd.getNumPartitions() <= 8
    assert back.count() == 900 and back.filter("seq = 2").select("data").distinct().collect() == [(bytearray([8]),)]
    assert back.filter("seq <= 1").count() == 600 and media.read_media(spark, f"{tmp_path}/*.wav", packets_per_partition="1").filter("seq >= 1").count() == 600


def test_neighbours_of_short_hashes(spark):
    rnd = np.random.default_rng(2)
    values = [int(v) for v in rnd.integers(0, 1 << 24, 300)]
    values = list(dict.fromkeys(values + [v ^ 1 << int(k) ^ 1 << int(n) for v, k, n in zip(values, rnd.integers(0, 24, 300), rnd.integers(0, 24, 300), strict=True)]))
    table = spark.createDataFrame(list(enumerate(values)), "frame_no long, hash long")
    got = [tuple(r) for r in neighbours.neighbours(table, 4, bits=24).collect()]
    assert sorted(got) == [(a, b, (x ^ y).bit_count()) for a, x in enumerate(values) for b, y in enumerate(values) if a < b and (x ^ y).bit_count() <= 4]


@pytest.mark.parametrize(("bits", "radius", "pieces"), [(24, 4, None), (24, 4, 9), (23, 3, 7), (7, 2, None), (5, 4, 4), (5, 2, 8), (64, 4, 6)])
def test_neighbours_are_given_once_whatever_the_pieces(spark, bits, radius, pieces):
    rnd = np.random.default_rng(bits)
    near = [int(v) for v in rnd.integers(0, 1 << min(bits, 9), 90)]
    values = list(dict.fromkeys([v << bits - min(bits, 9) for v in near] + near))
    table = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "frame_no long, hash long")
    got = [tuple(r) for r in neighbours.neighbours(table, radius, pieces=pieces, bits=bits).collect()]
    assert sorted(got) == [(a, b, (x ^ y).bit_count()) for a, x in enumerate(values) for b, y in enumerate(values) if a < b and (x ^ y).bit_count() <= radius]


def test_dealt_hashes_are_not_broadcast(spark):
    # few bytes before they are dealt out under keys, which is what Spark goes by
    table = spark.createDataFrame([(k, 977 * k) for k in range(3000)], "frame_no long, hash long")
    for pairs in (neighbours.neighbours(table, 4, bits=24), neighbours.nearest(table, table.limit(5), 4, bits=24)):
        assert pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_few_hashes_are_dealt_out_in_many_tasks(spark):
    table = spark.createDataFrame([(k, 977 * k) for k in range(3000)], "frame_no long, hash long")
    few = table.groupBy("hash").agg(F.min("frame_no").alias("frame_no"))
    assert few.select(F.spark_partition_id().alias("p")).distinct().count() == 1
    assert neighbours.spread(few, "hash").select(F.spark_partition_id().alias("p")).distinct().count() == 4
