"""Round trips of the container writers and readers."""

import random

import pytest

from cinelake.sources import containers as C


def made(streams, n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = i % 4 == 0
        body = (b"\0\0\0\1\x65" if key else b"\0\0\0\1\x41") + bytes(rnd.randint(1, 255) for _ in range(rnd.choice([1, 50, 170, 175, 183, 184, 700])))
        out.append(C.Packet(i % streams, 3000 * i + 600, 3000 * i, key, 0, body))
    return out


def test_ivf():
    frames = [(i * 3, bytes([i % 2, i])) for i in range(5)]
    got = list(C.parse_ivf(C.write_ivf(frames, 16, 8)))
    assert [(p.pts, p.data) for p in got] == frames and [p.keyframe for p in got] == [True, False] * 2 + [True]


@pytest.mark.parametrize("seed", range(4))
def test_ts(seed):
    packets = made(2, 40, seed)
    raw = C.write_ts(packets, [0x1B, 0x0F])
    assert len(raw) % 188 == 0
    got = sorted(C.parse_ts(raw), key=lambda p: p.dts)
    assert [(p.stream_index, p.pts, p.dts, p.data) for p in got] == [(p.stream_index, p.pts, p.dts, p.data) for p in packets]
    assert all(p.keyframe == q.keyframe for p, q in zip(got, packets, strict=True) if p.stream_index == 0)
    assert len(list(C.parse_ts(raw, flush=False))) == 38  # the last of each stream stays open


def test_ts_time_uses_33_bits():
    t = (1 << 33) - 7
    assert C.time33(C.pack_time33(t, 2)) == t
    with pytest.raises(ValueError):
        list(C.parse_ts(b"\0" * 188))


def test_avi():
    packets = made(2, 12)
    raw = C.write_avi(packets, [b"vids", b"auds"])
    got = list(C.parse_avi(raw))
    assert [(p.stream_index, p.keyframe, p.data) for p in got] == [(p.stream_index, p.keyframe, p.data) for p in packets]
    assert [p.pts for p in got if p.stream_index == 1] == list(range(6))
    walked = list(C.parse_avi(raw[: raw.rindex(b"idx1")]))
    assert [p.data for p in walked] == [p.data for p in packets]


def test_read_packets(spark, tmp_path):
    (tmp_path / "a.ivf").write_bytes(C.write_ivf([(0, b"xy")], 2, 2))
    (tmp_path / "b.avi").write_bytes(C.write_avi(made(1, 3), [b"vids"]))
    (tmp_path / "c.txt").write_bytes(b"no media")
    rows = C.read_packets(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[-1], r.seq, r.size) for r in rows) == sorted([("a.ivf", 0, 2)] + [("b.avi", i, len(p.data)) for i, p in enumerate(made(1, 3))])


def test_amf0():
    assert C.amf0({"a": 1, "b": [True, None, "é"]}).hex() == "0300016100" + "3ff0000000000000" + "000162" + "0a00000003" + "0101" + "05" + "020002c3a9" + "000009"
    with pytest.raises(TypeError):
        C.amf0(b"x")
