"""Matroska, MP4, Ogg, FLAC and MP3 readers against the sinks and handmade files."""

import io
import random
import struct

import pytest

from cinelake.sources import containers as C
from cinelake.sources import sinks, streams
from tests.test_media import packets


def sent(spark, n=60, seed=1, files=("x",), suffix="webm"):
    rnd = random.Random(seed)
    rows = [(f"{f}.{suffix}", i % 2, i, 40 * i, 40 * i, i % 2 == 1 or i % 10 == 0, bytearray(rnd.randbytes(rnd.choice([1, 90, 300, 20000])))) for f in files for i in range(n)]
    return rows, packets(spark, rows)


def same(got, rows):
    assert [(r.stream_index, r.pts, r.keyframe, bytes(r.data)) for r in got] == [(r[1], r[3], r[5], bytes(r[6])) for r in rows]


def test_webm_round_trip(spark, tmp_path):
    rows, table = sent(spark, files=("x", "y"))
    sinks.write(table.repartition(4), str(tmp_path), "webm", codecs="V_VP9,A_OPUS", cluster_ms="500")
    got = streams.read(spark, str(tmp_path / "*.webm")).orderBy("file", "seq").collect()
    same(got, rows)
    raw = (tmp_path / "x.webm").read_bytes()
    assert raw.count((0x1F43B675).to_bytes(4, "big")) >= 4
    assert all(raw[r.position :].find(bytes(r.data)) >= 0 for r in got if r.file.endswith("x.webm"))


def test_matroska_groups_and_lacing():
    block = lambda flags, body: bytes([0x81]) + struct.pack(">hB", 5, flags) + body
    ref = sinks.element(0xFB, b"\xff")
    cluster = sinks.number_element(0xE7, 100) + sinks.element(0xA0, sinks.element(0xA1, block(0, b"key"))) + sinks.element(0xA0, sinks.element(0xA1, block(0, b"dep")) + ref)
    cluster += sinks.element(0xA3, block(0x82, b"\x02\x01\x02" + b"abbccc")) + sinks.element(0xA3, block(0x04, b"\x01xxyy")) + sinks.element(0xA3, block(0x06, b"\x02\x82\xc0" + b"aabbbbb"))
    raw = sinks.element(0x1A45DFA3, b"") + sinks.element(0x18538067, sinks.element(0x1549A966, sinks.number_element(0x2AD7B1, 2_000_000)) + sinks.element(0x1654AE6B, sinks.element(0xAE, sinks.number_element(0xD7, 1))) + sinks.element(0x1F43B675, cluster))
    got = list(streams.parse_matroska(io.BytesIO(raw)))
    assert [(p.pts, p.keyframe, p.data) for p in got[:2]] == [(210, True, b"key"), (210, False, b"dep")]
    assert [p.data for p in got[2:]] == [b"a", b"bb", b"ccc", b"xx", b"yy", b"aa", b"bbb", b"bb"][:5] + [p.data for p in got[7:]]
    assert b"".join(p.data for p in got[7:]) == b"aabbbbb" and len(got) == 10
    with pytest.raises(ValueError):
        list(streams.parse_matroska(io.BytesIO(b"\x42\x82\x81a" * 4)))


def test_mp4_round_trip_and_ranges(spark, tmp_path):
    rows, table = sent(spark, suffix="mp4")
    sinks.write(table, str(tmp_path), "mp4", kinds="vide,soun", codecs="vp09,sowt")
    path = str(tmp_path / "x.mp4")
    got = streams.read(spark, path, range_bytes=20_000).orderBy("seq").collect()
    # each track's first sample, then the second, as they were sent
    assert [r.seq for r in got] == list(range(60))
    assert [(r.stream_index, bytes(r.data)) for r in got] == [(r[1], bytes(r[6])) for r in rows]
    assert [r.pts for r in got if r.stream_index == 0] == [80 * i for i in range(30)]
    assert [r.keyframe for r in got if r.stream_index == 0] == [r[5] for r in rows if r[1] == 0] and all(r.keyframe for r in got if r.stream_index == 1)
    with open(path, "rb") as f:
        tracks = streams.tracks_of(streams.movie(f))
    assert [(t.kind, t.codec, t.scale, len(t.places)) for t in tracks] == [("vide", "vp09", 1000, 30), ("soun", "sowt", 1000, 30)]


def test_mp4_rewrites_start_codes(spark, tmp_path):
    sps, pps, idr = b"\x67\x42\x00\x1e\xaa", b"\x68\xce\x38", b"\x65" + bytes(range(1, 50))
    data = b"\0\0\0\1" + sps + b"\0\0\0\1" + pps + b"\0\0\1" + idr
    sinks.write(packets(spark, [("h.mp4", 0, 0, 0, 0, True, bytearray(data))]), str(tmp_path), "mp4")
    got = streams.read(spark, str(tmp_path / "h.mp4")).first()
    assert bytes(got.data) == struct.pack(">I", len(idr)) + idr
    raw = (tmp_path / "h.mp4").read_bytes()
    assert b"avcC" in raw and sps in raw[raw.index(b"avcC") :] and pps in raw[raw.index(b"avcC") :]


def test_ivf_ts_and_avi_sinks(spark, tmp_path):
    rows, table = sent(spark, 12, suffix="avi")
    sinks.write(table, str(tmp_path), "avi", kinds="vids,auds")
    raw = (tmp_path / "x.avi").read_bytes()
    assert struct.unpack_from("<I", raw, 4)[0] == len(raw) - 8
    assert [(p.stream_index, p.keyframe, p.data) for p in C.parse_avi(raw)] == [(r[1], r[5], bytes(r[6])) for r in rows]
    sinks.write(table, str(tmp_path), "ts", kinds="0x1B,0x0F")
    assert [p.data for p in sorted(C.parse_ts((tmp_path / "x.avi").read_bytes()), key=lambda p: p.dts)] == [bytes(r[6]) for r in rows]
    one = [("v.ivf", 0, i, 3 * i, 3 * i, True, bytearray([0, i])) for i in range(4)]
    sinks.write(packets(spark, one), str(tmp_path), "ivf", width="2", height="2")
    raw = (tmp_path / "v.ivf").read_bytes()
    assert [(p.pts, p.data) for p in C.parse_ivf(raw)] == [(r[3], bytes(r[6])) for r in one] and struct.unpack_from("<I", raw, 24)[0] == 4
    with pytest.raises(ValueError):
        sinks.write(table, str(tmp_path), "flv")


def page(serial, granule, sizes, body, flags=0):
    return b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, serial, 0, 0) + bytes([len(sizes)]) + bytes(sizes) + body


def test_ogg_packets_over_pages():
    long = bytes(range(256)) * 2
    raw = page(7, 10, [3, 255], b"abc" + long[:255]) + page(9, 5, [2], b"zz") + page(7, 20, [255, 2, 1], long[255:510] + long[510:] + b"!", flags=1)
    got = list(streams.parse_ogg(io.BytesIO(raw)))
    assert [(p.stream_index, p.pts, p.data) for p in got] == [(0, 10, b"abc"), (1, 5, b"zz"), (0, 20, long), (0, 20, b"!")]
    with pytest.raises(ValueError):
        list(streams.parse_ogg(io.BytesIO(b"x" * 40)))


def flac_frame(n, body):
    head = bytes([0xFF, 0xF8, 0xC9, 0x18, n])
    return head + bytes([streams.crc8(head)]) + body


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_flac_frames(piece):
    bodies = [b"\xff\xf8" + bytes([i] * 40) + b"\xff" for i in range(6)]
    raw = b"fLaC" + b"\x80\0\0\x04meta" + b"".join(flac_frame(i, b) for i, b in enumerate(bodies))
    got = list(streams.parse_flac(io.BytesIO(raw), piece))
    assert [p.data for p in got] == [flac_frame(i, b) for i, b in enumerate(bodies)] and [p.pts for p in got] == [4096 * i for i in range(6)]
    assert all(raw[p.position : p.position + len(p.data)] == p.data for p in got)


def test_mp3_frames():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # 128 kilobits at 44.1 kHz
    size, samples = streams.mp3_frame(head)
    assert (size, samples) == (417, 1152)
    tag = b"ID3\x03\0\0\0\0\0\x05hello"
    raw = tag + b"junk" + (head + bytes(size - 4)) * 3 + head
    assert [(p.pts, len(p.data), p.position) for p in streams.parse_mp3(io.BytesIO(raw))] == [(1152 * i, 417, 19 + 417 * i) for i in range(3)]


def test_seek(spark):
    rows = [(0, i, 10 * i, i in (2, 5)) for i in range(8)] + [(1, i, 7 * i, True) for i in range(4)]
    table = spark.createDataFrame(rows, "stream_index int, seq long, pts long, keyframe boolean")
    asked = [(0, t) for t in (-5, 0, 14, 15, 16, 29, 55, 999)] + [(1, 10), (1, 11), (3, 1)]
    got = {(r.stream_index, r["at"]): (r["sample"], r["sync"]) for r in streams.seek(table, spark.createDataFrame(asked, "stream_index int, at long")).collect()}
    for s, t in asked:
        own = [(abs(p - t), i + 1) for x, i, p, _ in rows if x == s]
        if not own:
            assert got[s, t] == (None, None)
            continue
        n = min(own)[1]
        assert got[s, t] == (n, max([i + 1 for x, i, _, k in rows if x == s and k and i < n], default=1))


def test_probe_of_files(spark, tmp_path):
    import json

    from cinelake.operators import catalog

    rows, table = sent(spark, 12)
    sinks.write(table, str(tmp_path), "webm", codecs="V_VP9,A_OPUS")
    row = catalog.probe(streams.read(spark, str(tmp_path / "*"))).first()
    got = json.loads(row.document)
    assert got["format"]["name"] == "webm" and got["format"]["duration"] == 400 and got["format"]["size"] == sum(len(r[6]) for r in rows)
    assert [(s["index"], s["packets"], s["duration"]) for s in got["streams"]] == [(0, 6, 400), (1, 6, 400)]
