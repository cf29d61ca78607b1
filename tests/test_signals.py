"""Ordered folds, synchronisation, loudness and resampling, against sequential forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators import audio, control, dsp, motion, resample, sync


def samples(spark, *signals):
    rows = [(s, i, int(v)) for s, x in enumerate(signals) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "stream long, i long, x int").repartition(5)


def sine(n, hz=440.0, rate=48_000, size=10_000):
    return [round(size * math.sin(2 * math.pi * hz * i / rate)) for i in range(n)]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_place(rows, name):
    return {(r.stream, r.i): r[name] for r in rows.collect()}


def test_filters_carry_their_state_over_batches(spark, small_batches):
    rnd = random.Random(0)
    signals = [[rnd.randint(-32768, 32767) for _ in range(n)] for n in (1, 40, 23)]
    table = samples(spark, *signals)
    for made, name, start in (
        (dsp.vu_meter(table), "vu", lambda: dsp.Level(dsp.coefficient(48_000, 300.0), dsp.coefficient(48_000, 300.0))),
        (dsp.peak_hold(table, 4, 8, 0.9), "peak", lambda: dsp.PeakHold(4, 8, 0.9)),
        (dsp.k_weighted(table), "y", lambda: dsp.chain(*[dsp.Biquad(*c) for c in dsp.k_weights(48_000)])),
    ):
        got = by_place(made, name)
        assert len(got) == sum(map(len, signals))
        for s, x in enumerate(signals):
            f = start()
            want = np.append(f(np.array(x) / 32768.0), f(None))  # a whole signal at once
            assert [got[s, i] for i in range(len(x))] == pytest.approx(want.tolist())


def test_compressor_by_hand(spark):
    x = [0, 20000, 30000, -30000, 100, 0, 32767]
    got = by_place(dsp.compressor(samples(spark, x), -20.0, 4.0, 6.0, 5.0, 50.0), "y")
    up, down, level = math.exp(-1000 / (48_000 * 5.0)), math.exp(-1000 / (48_000 * 50.0)), 0.0
    for i, v in enumerate(x):
        v /= 32768
        c = up if abs(v) > level else down
        level = c * level + (1 - c) * abs(v)
        over = 20 * math.log10(max(level, 1e-10)) + 20
        gain = 0.0 if 2 * over < -6 else (0.25 - 1) * (over + 3) ** 2 / 12 if 2 * abs(over) <= 6 else (0.25 - 1) * over
        assert got[0, i] == pytest.approx(v * 10 ** (gain / 20))


def test_gate_and_limiter(spark):
    quiet, loud = samples(spark, [10] * 4000), samples(spark, [32767] * 4000)
    assert abs(by_place(dsp.expander(quiet), "y")[0, 3999]) < 10 / 32768
    assert by_place(dsp.limiter(loud), "y")[0, 3999] < 0.95


def test_k_weighting_lets_low_tones_fall(spark):
    rows = samples(spark, sine(4800, 20.0), sine(4800, 1000.0), sine(4800, 6000.0))
    power = {r.stream: r.p for r in audio.weighted_power(rows).filter("i > 2400").groupBy("stream").agg(F.avg("power").alias("p")).collect()}
    assert power[0] < power[1] / 4 and power[2] > power[1]


def test_channel_weights(spark):
    x = sine(100)
    rows = spark.createDataFrame([(0, c, i, v) for c in range(6) for i, v in enumerate(x)], "stream long, channel long, i long, x int")
    one = by_place(audio.weighted_power(rows.filter("channel = 0")), "power")
    six = by_place(audio.weighted_power(rows), "power")
    two = by_place(audio.weighted_power(rows.filter("channel < 2")), "power")
    assert all(six[k] == pytest.approx(v * 5.82) and two[k] == pytest.approx(v * 2) for k, v in one.items())


def test_loudness_blocks_overlap_and_are_bounded(spark):
    rows = spark.range(95).select(F.lit(0).alias("stream"), F.col("id").alias("i"), F.lit(1.0).alias("power"))
    got = audio.loudness_blocks(rows, 40, 10, most=4).orderBy("block").collect()
    assert [r.block for r in got] == [2, 3, 4, 5] and all(r.lufs == pytest.approx(-0.691) for r in got)
    silent = rows.withColumn("power", F.lit(0.0))
    assert {r.lufs for r in audio.loudness_blocks(silent, 40, 10).collect()} == {float("-inf")}


def test_offset_of_a_delayed_tone(spark):
    tone = sine(1000)
    row = sync.sync_offset(samples(spark, tone), samples(spark, [0] * 100 + tone)).first()
    # a hundred samples of silence ahead, but for whole periods of the tone; with no lag past the difference of lengths
    assert 50 <= row.offset < 150 and row.confidence > 0.9
    back = sync.sync_offset(samples(spark, [0] * 100 + tone), samples(spark, tone)).first()
    assert back.offset == -row.offset
    same = sync.sync_offset(samples(spark, tone), samples(spark, [*tone, *[0] * 100]), 1000).first()
    assert same.offset == 0 and same.confidence == pytest.approx(1.0)
    none = sync.sync_offset(samples(spark, tone), samples(spark, tone)).first()
    assert (none.offset, none.confidence) == (0, 0.0)  # equal lengths below the search range


def test_lag_scores_are_direct_sums():
    rnd = np.random.default_rng(3)
    reference, search = rnd.integers(-99, 99, 50).astype(float), rnd.integers(-99, 99, 90).astype(float)
    got = sync.scores(reference, search, 41)
    want = [search[k : k + 50] @ reference / math.sqrt((reference @ reference) * (search[k : k + 50] @ search[k : k + 50])) for k in range(41)]
    assert got.tolist() == pytest.approx(want)
    assert sync.scores(reference, np.zeros(90), 41).tolist() == [0.0] * 41


def test_spikes_and_their_offset(spark):
    one, two = [3277] * 12000, [3277] * 12000
    one[5000], two[5200] = 32767, 32767
    a, b = sync.spikes(samples(spark, one)), sync.spikes(samples(spark, two))
    assert [(r.i, r.confidence) for r in a.collect()] == [(5000, 1.0)]
    assert sync.spike_offset(a, b).collect() == [(0, 200, 1.0)]
    assert sync.spike_offset(a, b, 150).collect() == [(0, 0, 0.0)]
    assert sync.spike_offset(a, sync.spikes(samples(spark, [0] * 50))).count() == 0


def test_spikes_are_spaced_greedily(spark, small_batches):
    rnd = random.Random(5)
    signals = [[rnd.randint(-1000, 1000) for _ in range(400)] for _ in range(3)]
    got = sorted((r.stream, r.i) for r in sync.spikes(samples(spark, *signals), 0.3, 9).collect())
    want = []
    for s, x in enumerate(signals):
        a, last = [abs(v) for v in x], 0
        for i, v in enumerate(a):
            if v > 0.3 * max(a) and i - last > 9 and (i == 0 or v > a[i - 1]) and (i == len(a) - 1 or v > a[i + 1]):
                want.append((s, i))
                last = i
    assert got == want


def test_drift_of_a_faster_signal(spark):
    rnd = random.Random(6)
    base = [rnd.randint(-9999, 9999) for _ in range(4000)]
    late = [base[i - 4 * (i // 400)] if i >= 4 * (i // 400) else 0 for i in range(4000)]  # four samples behind in each segment
    got = sync.drift(samples(spark, late), samples(spark, base), 400, 50).first()
    assert got.drift == pytest.approx(4 / 400)
    assert sync.drift(samples(spark, base[:700]), samples(spark, base[:700]), 400, 50).first().drift is None


def test_each_job_goes_to_one_worker(spark):
    rnd = random.Random(7)
    jobs = [(i, rnd.randint(0, 3), rnd.randint(0, 20), rnd.choice(["queued", "queued", "running"]), rnd.choice([0, 1, 2, None]), rnd.choice(["gpu", None, None])) for i in range(200)]
    workers = [(w, rnd.sample(range(3), rnd.randint(0, 3)), rnd.choice([["gpu"], []]), rnd.choice(["ready", "ready", "busy"]), rnd.randint(0, 2), 2) for w in range(60)]
    got = control.assign_jobs(spark.createDataFrame(jobs, "job_id long, priority int, created long, state string, codec int, hw string"), spark.createDataFrame(workers, "worker_id long, codecs array<int>, hws array<string>, state string, running int, most int")).collect()
    left = sorted((j for j in jobs if j[3] == "queued"), key=lambda j: (-j[1], j[2], j[0]))
    want = []
    for w, codecs, hws, state, running, most in workers:
        if state == "ready" and running < most:
            job = next((j for j in left if (j[4] is None or j[4] in codecs) and (j[5] is None or j[5] in hws)), None)
            if job:
                left.remove(job)
                want.append((w, job[0]))
    assert sorted((r.worker_id, r.job_id) for r in got) == want
    assert len({r.job_id for r in got}) == len(got) > 10


def test_frame_plan(spark):
    scenes = {7, 9, 20}
    rows = spark.range(30).select(F.lit(0).alias("stream"), F.col("id").alias("idx"), F.col("id").isin(*scenes).alias("scene"))
    plan = lambda **k: "".join(r.planned[0] for r in control.group_frame_types(rows, **k).orderBy("idx").collect())
    assert plan(most=12, least=3, between=2) == "IBBPBBP" + "IBBPBBPBBPBB" + "IBBPBBPBBPB"
    assert plan(most=5, least=99, between=0) == "IPPPP" * 6
    assert plan(most=99, interval=4, least=99, between=3) == "IBBB" * 7 + "IB"
    assert control.group_frame_types(rows, 12, idr=True).orderBy("idx").first().planned == "IDR"


def test_segments_over_batches(spark, small_batches):
    rnd = random.Random(8)
    packets, want = [], {}
    for s in range(3):
        now, pts = None, 0
        for seq in range(90):
            pts += rnd.randint(0, 40)
            key, size = rnd.random() < 0.2, rnd.randint(1, 9)
            packets.append((s, seq, pts, size, key))
            e = max(pts - now[2], 0) if now else 0
            if now is None or (key and e >= 100) or e >= 200:
                now = [s, now[1] + 1 if now else 0, pts, 0, 0, 0]
            now[3:] = [pts - now[2], now[4] + size, now[5] + 1]
            want[s, now[1]] = tuple(now)
    got = control.segments(spark.createDataFrame(packets, "stream long, seq long, pts long, size long, keyframe boolean").repartition(4), 100, 200).collect()
    assert {(r.stream, r.segment): tuple(r) for r in got} == want


def rate_points(curve, shift=0.0):
    return [(1, curve, 100.0 * 2**k, 30.0 + 3 * k - 0.1 * k * k + shift) for k in range(5)]


def test_bd_rate_of_shifted_curves(spark):
    table = lambda b: spark.createDataFrame([*rate_points("a"), *b], "key long, curve string, rate double, psnr double")
    half = [(1, "b", r / 2, p) for _, _, r, p in rate_points("b")]
    assert control.bd_rate(table(half)).first().delta == pytest.approx(-50.0)
    assert control.bd_rate(table(rate_points("b", 1.5)), "psnr").first().delta == pytest.approx(1.5)
    assert control.bd_rate(table(half[:2])).first().delta == pytest.approx((np.mean([50, 100]) / np.mean([100 * 2**k for k in range(5)]) - 1) * 100)
    assert {r.curve: r.psnr for r in control.average_psnr(table(half)).collect()} == {"a": pytest.approx(35.4), "b": pytest.approx(35.4)}


def test_sinc_resampling_by_hand(spark):
    x = [random.Random(9).randint(-900, 900) for _ in range(40)]
    got = by_place(resample.convert(samples(spark, x), 48_000, 32_000, "sinc", 4), "y")
    for k in range(26):
        place = k * 1.5
        base = math.floor(place)
        terms = [(np.sinc(place - j) * np.sinc((place - j) / 4), x[min(max(j, 0), 39)]) for j in range(base - 3, base + 5)]
        assert got[0, k] == pytest.approx(sum(w * v for w, v in terms) / sum(w for w, _ in terms))


def test_polyphase_is_the_stepwise_filter(spark):
    x = [random.Random(10).randint(-900, 900) for _ in range(50)]
    for rate, to in ((3, 2), (2, 3), (1, 1)):
        up, down = to, rate
        taps, state, want = resample.low_pass(8 * up, up), [0.0] * 8 * up, []
        for t in range(len(x) * up):
            state = [x[t // up] if t % down == 0 else 0.0, *state[:-1]]
            if t % down == 0:
                want.append(sum(a * b for a, b in zip(state, taps, strict=True)))
        got = by_place(resample.polyphase(samples(spark, x), rate, to, 8), "y")
        assert [got[0, k] for k in range(len(want))] == pytest.approx(want) and len(got) == len(want)


def test_inverse_pulldown_walks_the_strides(spark):
    rows = spark.range(200).withColumnRenamed("id", "frame_no")
    for cadence, pattern in motion.PULLDOWN.items():
        want, i = [], 0
        while i < 200:
            want.append(i)
            i += pattern[i % len(pattern)]
        assert sorted(r.frame_no for r in motion.inverse_pulldown(rows, cadence).collect()) == want


@pytest.mark.parametrize("method", ["nearest", "linear", "sinc"])
def test_conversion_in_blocks(spark, method):
    rnd = random.Random(8)
    signals = [[rnd.randint(-9000, 9000) for _ in range(n)] for n in (1, 2, 59, 400)]
    for rate, to in ((48_000, 32_000), (3, 7), (2, 1)):
        table = samples(spark, *signals)
        whole = by_place(resample.convert(table, rate, to, method, 3), "y")
        cut = by_place(resample.convert(table, rate, to, method, 3, block=10), "y")
        assert set(whole) == {(s, k) for s, x in enumerate(signals) for k in range(len(x) * to // rate)}
        assert cut.keys() == whole.keys() and all(cut[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)
        x = np.array(signals[3], float)
        for k in range(len(x) * to // rate):
            place = k * rate / to
            if method == "nearest":
                assert whole[3, k] == x[min(int(place + 0.5), len(x) - 1)]
            elif method == "linear":
                assert whole[3, k] == pytest.approx(np.interp(place, np.arange(len(x)), x))


def test_pcm_formats(spark):
    from cinelake.operators import codecs

    x = [0.0, 0.5, -0.5, 0.999, -1.0, 1.5, -3.0, 1 / 3]
    table = spark.createDataFrame([(1, x), (2, []), (3, None)], "k long, samples array<double>")
    for kind, bits in (("u8", 8), ("s8", 8), ("s16be", 16), ("s24le", 24), ("s24be", 24), ("s32le", 32), ("s32be", 32), ("f32le", None), ("f64be", None)):
        coded = codecs.encode(table, f"pcm_{kind}")
        back = {r.k: r.samples for r in codecs.decode(coded, f"pcm_{kind}").collect()}
        top = 2.0 ** (bits - 1) if bits else None
        want = [min(max(math.trunc(v * top), -top), top - 1) / top for v in x] if bits else x
        assert back[1] == pytest.approx(want, abs=1e-7) and back[2] == [] and back[3] is None
    one = {r.k: bytes(r.data) for r in codecs.encode(table.limit(1), "pcm_s24le").collect()}
    assert one[1][:6] == b"\0\0\0\0\0\x40"
    assert bytes(codecs.encode(table.limit(1), "pcm_u8").first().data)[:3] == bytes([128, 192, 64])
    with pytest.raises(ValueError, match="bytes left over"):
        resample.unpacked(b"\0\0\0", "s16le")
    with pytest.raises(ValueError, match="no sample format"):
        resample.decode_samples(F.lit(b""), "s17")
