"""Filters that are split within a stream against the sequential ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators import dsp, linear


def sequential(filters, x):
    for f in filters:
        x = f(x)
    return x


def signal(n, seed=0):
    rnd = random.Random(seed)
    return [int(9000 * math.sin(k / 7) + rnd.randint(-4000, 4000)) for k in range(n)]


def test_systems_equal_sequential_filters():
    x = np.array(signal(5000)) / 32768.0
    for n in (0, 1, 5, 47, 48, 1000, 5000):
        bands = [(100.0, 6.0, 1.0), (1000.0, -9.0, 0.7), (8000.0, 3.0, 2.0)]
        made = linear.cascade(*[linear.biquad(*dsp.peaking(48_000, *b)) for b in bands])
        y, state = linear.filtered(made, x[:n], made.rest())
        assert np.allclose(y, sequential([dsp.Biquad(*dsp.peaking(48_000, *b)) for b in bands], x[:n]), atol=1e-12)
        again = linear.step_by_step(made, x[:n], made.rest())
        assert np.allclose(again[0], y, atol=1e-12) and np.allclose(again[1], state, atol=1e-12)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(s, 3 * k if s == 2 else k, v) for s, n in ((0, 1), (1, 700), (2, 1234)) for k, v in enumerate(signal(n, s))]
    return rows, spark.createDataFrame(rows, "stream long, i long, x int").repartition(5)


@pytest.mark.parametrize("block", [1, 100, 1 << 16])
def test_blocks_equal_one_pass(samples, block):
    rows, table = samples
    weights = [linear.biquad(*c) for c in dsp.k_weights(48_000)]
    cases = [
        (dict(system=linear.cascade(*weights)), lambda x: sequential([dsp.Biquad(*c) for c in dsp.k_weights(48_000)], x)),
        (dict(system=linear.smoothing(0.99), magnitude=True), dsp.Level(0.99, 0.99)),
    ]
    for options, one in cases:
        got = {(r.stream, r.i): r.y for r in linear.linear_filter(table, name="y", block=block, **options).collect()}
        assert len(got) == len(rows)
        for s in range(3):
            own = sorted((i, x) for t, i, x in rows if t == s)
            f = dsp.Level(0.99, 0.99) if isinstance(one, dsp.Level) else one
            want = f(np.array([x for _, x in own]) / 32768.0)
            assert np.allclose([got[s, i] for i, _ in own], want, atol=1e-9)


def test_from_first_and_several_keys(spark):
    rows = [(c, d, i, float(11 + i + d)) for c in (1, None) for d in (0, 1) for i in range(60)]
    table = spark.createDataFrame(rows, "stream long, channel long, i long, v double")
    out = linear.linear_filter(table, linear.smoothing(0.5), "y", ("stream", "channel"), "v", 1.0, from_first=True, block=7)
    got = {(r.stream, r.channel, r.i): r.y for r in out.collect()}
    assert len(got) == 240
    for d in (0, 1):
        level = 11.0 + d
        for i in range(60):
            level = 0.5 * level + 0.5 * (11.0 + i + d)
            assert got[1, d, i] == got[None, d, i] == pytest.approx(level, abs=1e-9)


def test_one_long_stream_is_cut(spark):
    long = spark.range(300_000).select(F.lit(1).alias("stream"), F.col("id").alias("i"), F.expr("cast(id * 37 % 2001 - 1000 as int)").alias("x"))
    out = dsp.vu_meter(long)
    blocks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in blocks) == 300_000
    x = np.abs(np.arange(300_000) * 37 % 2001 - 1000) / 32768.0
    want = dsp.Level(dsp.coefficient(48_000, 300.0), dsp.coefficient(48_000, 300.0))(x)
    got = np.array([r.vu for r in out.orderBy("i").collect()])
    assert np.allclose(got, want, atol=1e-9)
