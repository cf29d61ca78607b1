"""Plane kernels, documents and command lines."""

import math

import numpy as np
import pytest

from cinelake.operators import chain, documents, kernels, pixels


def planes(spark, *arrays):
    return spark.createDataFrame([(i, a.ravel().tolist()) for i, a in enumerate(arrays)], "frame_no long, p array<int>")


def test_constant_planes_stay(spark):
    frames = planes(spark, np.full((6, 8), 77))
    for made in (kernels.scale(frames, 8, 6, 13, 5), kernels.gaussian_denoise(frames, 8, 6, 1.2), kernels.unsharp(frames, 8, 6, 1.0, 2.0), kernels.bilateral(frames, 8, 6, 2, 1.0, 9.0)):
        assert set(made.first().p) == {77}
    assert len(kernels.scale(frames, 8, 6, 13, 5).first().p) == 65


def test_gaussian_equals_direct_sums(spark):
    a = np.random.default_rng(0).integers(0, 256, (5, 7))
    w = kernels.gaussian_weights(0.8)
    r = len(w) // 2
    want = [[math.floor(round(sum(w[i + r] * w[j + r] * a[min(max(y + i, 0), 4), min(max(x + j, 0), 6)] for i in range(-r, r + 1) for j in range(-r, r + 1)), 9)) for x in range(7)] for y in range(5)]
    assert kernels.gaussian_denoise(planes(spark, a), 7, 5, 0.8).first().p == np.ravel(want).tolist()


def test_ssim_of_equal_and_small_planes():
    a = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(float)
    assert kernels.ssim(a, a) == 1.0 and kernels.multi_scale_ssim(a, a) == 1.0
    assert kernels.ssim(a, 255 - a) < 0.2
    with pytest.raises(ValueError):
        kernels.ssim(a[:4], a[:4])


def test_error_diffusion_keeps_the_mean(spark):
    a = np.full((16, 16), 514)
    for plane in (a, np.random.default_rng(5).integers(0, 1200, (16, 16))):
        left, want = plane.astype(int).ravel().tolist(), []
        for k in range(256):
            y, x = divmod(k, 16)
            want.append(min(max(left[k], 0), 1023) * 255 // 1023)
            lost = left[k] - want[-1] * 1023 // 255
            for j, w, there in ((k + 1, 7, x < 15), (k + 15, 3, x > 0), (k + 16, 5, True), (k + 17, 1, x < 15)):
                if there and j < 256:
                    left[j] += int(lost * w / 16)
        assert kernels.floyd_steinberg(planes(spark, plane), 16, 16).first().p == want


def test_perceptual_hash_survives_brightness(spark):
    a = np.add.outer(np.arange(16) * 5, np.arange(16) * 3) + np.random.default_rng(2).integers(0, 40, (16, 16))
    rows = kernels.perceptual_hash(planes(spark, a, a + 9, np.random.default_rng(3).integers(0, 200, (16, 16))), 16, 16).orderBy("frame_no").collect()
    distance = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert distance(rows[0].hash, rows[1].hash) <= 1 < distance(rows[0].hash, rows[2].hash)


def test_chain_is_one_plan(spark):
    frames = planes(spark, np.arange(4).reshape(2, 2))
    made = chain.FilterChain().add("flip", lambda f: pixels.flip(f, 2, 2)).add("turn", lambda f: pixels.rotate(f, 2, 2, 180))
    assert made.names() == ["flip", "turn"] and made.apply(frames).first().p == [2, 3, 0, 1]


def test_command_lines():
    job = documents.parse_command("ffmpeg -y -ss 1:30 -to 00:02:00.5 -i 'a b.mov' -c:v h264 -b:v 2M -weird out.mp4")
    assert job.inputs == ["a b.mov"] and job.output == "out.mp4" and job.extra == ["-weird"]
    assert job.params["video_codec"] == "h264" and job.params["overwrite"] == "true"
    assert job.seconds() == pytest.approx(30.5)
    assert documents.parse_command("-t 5 -to 9 x").seconds() == 5.0 and documents.parse_command("x").seconds() is None
    with pytest.raises(ValueError):
        documents.parse_command("-i")


def test_codecs_by_name(spark):
    from cinelake.operators import codecs

    rows = spark.createDataFrame([(0, [1, -2, 40000])], "seq long, samples array<int>")
    back = codecs.decode(codecs.encode(rows, "pcm"), "pcm_s16le")
    assert back.first().samples == [1, -2, 32767]
    codecs.register("twice", decoder=lambda c: c * 2)
    assert codecs.decode(spark.range(1, 2).withColumnRenamed("id", "data"), "twice").first().samples == 2
    for call in (codecs.decode, codecs.encode):
        with pytest.raises(ValueError):
            call(rows, "av1")


def test_command_line_options():
    job = documents.parse_command("ffmpeg -y -i a.mkv -c copy -vb 2M -filter:v scale -o out.mp4 -weird -bf 2 -framerate 25")
    assert (job.inputs, job.output, job.extra) == (["a.mkv"], "out.mp4", ["-weird"])
    assert job.params == {"overwrite": "true", "video_codec": "copy", "audio_codec": "copy", "video_bitrate": "2M", "video_filter": "scale", "b_frames": "2", "frame_rate": "25"}
    with pytest.raises(ValueError):
        documents.parse_command("ffmpeg -i a -crf")
