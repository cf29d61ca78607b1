"""Whole frames as bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators import kernels, video


def frames(spark, *arrays, width, height, stream=0):
    rows = [(stream, i, width, height, bytearray(a)) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, video.FRAME)


def noise(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n).astype(np.uint8)


def test_scale_of_planes_equals_kernels(spark):
    data = noise(0, 96)
    got = video.scale(frames(spark, data.tobytes(), width=8, height=8), 6, 10).first()
    y = data[:64].reshape(8, 8).astype(float)
    want = kernels.to_bytes(kernels.lanczos_weights(8, 10) @ y @ kernels.lanczos_weights(8, 6).T)
    assert (got.width, got.height, len(got.data)) == (6, 10, 60 + 2 * 15)
    assert np.frombuffer(got.data[:60], np.uint8).tolist() == want.ravel().astype(int).tolist()


def test_crop_outside_is_an_error(spark):
    with pytest.raises(Exception, match="leaves the frame"):
        video.crop(frames(spark, bytes(96), width=8, height=8), 6, 0, 4, 4).collect()
    with pytest.raises(ValueError):
        video.rotate(frames(spark, bytes(96), width=8, height=8), 45)


def test_gray_survives_the_round_trip(spark):
    rgb = b"".join(bytes([v] * 3) for v in noise(1, 24).tolist())
    one = frames(spark, rgb, width=6, height=4)
    back = video.yuv420p_to_rgb(video.rgb_to_yuv420p(one)).first()
    assert np.abs(np.frombuffer(back.data, np.uint8).astype(int) - np.frombuffer(rgb, np.uint8)).max() <= 1


def test_equal_frames_compare_as_equal(spark):
    a = frames(spark, noise(2, 384).tobytes(), width=16, height=16)
    row = video.compare(a, a).first()
    assert row.mse_y == 0 and row.psnr_avg == float("inf") and row.ssim_avg == row.ms_ssim == 1.0
    with pytest.raises(Exception, match="unequal size"):
        video.compare(a, frames(spark, bytes(400), width=16, height=16)).collect()


def test_history_crosses_blocks(spark):
    many = frames(spark, *[bytes([i] * 12) for i in range(20)], width=2, height=2)
    rows = video.with_history(many, 3, lambda d, w, h, before: (sum(x[0] for x in before), len(before)), "total long, n int", block=5).collect()
    assert sorted((r.frame_no, r.total, r.n) for r in rows) == [(i, sum(range(max(0, i - 3), i)), min(i, 3)) for i in range(20)]


def test_hashes_of_a_gradient(spark):
    ramp = np.repeat(np.tile(np.arange(0, 256, 8, dtype=np.uint8), (32, 1))[:, :, None], 3, 2)
    row = video.hashes(frames(spark, ramp.tobytes(), ramp[:, ::-1].tobytes(), width=32, height=32)).orderBy("frame_no").collect()
    assert row[0].difference == -1 and row[1].difference == 0
    assert row[0].average ^ row[1].average == -1  # each half is bright in one of them


def test_feather_leaves_borders():
    m = np.zeros((7, 7), np.uint8)
    m[3, 3] = 250
    soft = video.feathered(m, 1)
    assert soft[2:5, 2:5].tolist() == [[27] * 3] * 3 and soft[0].sum() == 0 and video.feathered(m, 4).tolist() == m.tolist()


def test_overlay_draws_digits(spark):
    row = video.overlay(frames(spark, bytes(3 * 40 * 12), width=40, height=12), F.lit("1:07"), 1, 1, 2).first()
    x = np.frombuffer(row.data, np.uint8).reshape(12, 40, 3)[..., 0] > 0
    assert x.any() and not x[:, 0].any() and not x[0].any()
    assert x[1:11:2, 1:7:2].astype(int).tolist() == [[0, 1, 0], [1, 1, 0], [0, 1, 0], [0, 1, 0], [1, 1, 1]]


def test_denoise_passes_the_first_frame_and_blends(spark):
    rows = video.temporal_denoise(frames(spark, bytes([10] * 12), bytes([20] * 12), width=2, height=2), 2, 1.0, 50.0).orderBy("frame_no").collect()
    assert [r.data[0] for r in rows] == [10, 15]


def test_cube_of_the_identity_and_of_the_inverse(spark):
    data = noise(5, 60).tobytes()
    axis = [k / 4 for k in range(5)]
    same = [(r, g, b) for b in axis for g in axis for r in axis]
    one = frames(spark, data, width=5, height=4)
    assert bytes(video.apply_cube(one, 5, same).first().data) == data
    back = video.apply_cube(one, 2, [(1.0 - r, 1.0 - g, 1.0 - b) for b in (0, 1) for g in (0, 1) for r in (0, 1)]).first().data
    assert bytes(back) == bytes(255 - v for v in data)


def test_fades_stop_before_the_end(spark):
    luma = [0.9, 0.5, 0.05, 0.9, 0.5, 0.05]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(luma)], "stream long, frame_no long, luma double")
    assert [tuple(r) for r in video.fades(rows, 3).collect()] == [(0, 0, 3)]


def by_hand(x, w, h):
    out = np.zeros((h, w, 3))
    for y in range(h):
        for k in range(w):
            sy, sx = y * x.shape[0] / h, k * x.shape[1] / w
            y0, x0 = int(sy), int(sx)
            y1, x1, fy, fx = min(y0 + 1, x.shape[0] - 1), min(x0 + 1, x.shape[1] - 1), sy - y0, sx - x0
            out[y, k] = (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy
    return np.floor(np.round(out, 4)).astype(int)


def test_fit_modes(spark):
    x = noise(6, 6 * 4 * 3).reshape(4, 6, 3).astype(float)
    one = frames(spark, x.astype(np.uint8).tobytes(), width=6, height=4)
    got = lambda *a: np.frombuffer(video.fit(one, *a).first().data, np.uint8).reshape(a[1], a[0], 3).astype(int)
    assert (got(9, 5, "stretch") == by_hand(x, 9, 5)).all()
    assert (got(4, 4, "fill") == by_hand(x, 6, 4)[:, 1:5]).all() and (got(6, 2, "fill") == by_hand(x, 6, 4)[1:3]).all()
    boxed = got(6, 8, "fit", (1, 2, 3))
    assert (boxed[2:6] == by_hand(x, 6, 4)).all() and (boxed[:2] == [1, 2, 3]).all() and (boxed[6:] == [1, 2, 3]).all()
    assert (got(6, 8, "pillarbox", (1, 2, 3)) == boxed).all()  # twelve columns do not fit in six
    side = got(12, 4, "fit")
    assert (side[:, 3:9] == by_hand(x, 6, 4)).all() and not side[:, :3].any() and not side[:, 9:].any()
    with pytest.raises(ValueError):
        video.fit(one, 4, 4, "guess")


def test_limited_range(spark):
    rgb = bytes([0] * 12) + bytes([255] * 12)
    made = video.rgb_to_yuv420p(frames(spark, rgb[:12], rgb[12:], width=2, height=2), full=False).orderBy("frame_no")
    assert [list(r.data) for r in made.collect()] == [[16] * 4 + [128, 128], [235] * 4 + [128, 128]]
    assert [set(r.data) for r in video.yuv420p_to_rgb(made, full=False).orderBy("frame_no").collect()] == [{0}, {255}]
