"""Scans in byte ranges against the parse of whole files."""

import io
import random
import struct

import pytest

from cinelake.sources import containers as C
from cinelake.sources import media, packet_index, sinks, streams
from tests.test_containers import made
from tests.test_streams import sent


def columns(p):
    return (p.stream_index, p.pts, p.dts, p.keyframe, p.position, bytes(p.data))


def same(spark, path, whole, sizes):
    for size in sizes:
        got = packet_index.read(spark, str(path), size).orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(len(got)))
        assert [columns(r) for r in got] == [columns(p) for p in whole], size
        assert all(r.size == len(r.data) for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_ts_ranges(spark, tmp_path, seed):
    raw = C.write_ts(made(2, 60, seed), [0x1B, 0x0F])
    (tmp_path / "a.ts").write_bytes(raw)
    same(spark, tmp_path / "a.ts", list(C.parse_ts(raw)), [188 * 7, 9000, 1 << 20])


def test_ts_with_tables_in_between_and_broken_packets(spark, tmp_path):
    counters: dict[int, int] = {}
    first, rest = made(2, 20, 5), made(3, 40, 6)
    raw = b"".join(C.ts_packet(p, [0x1B, 0x0F], counters) for p in first[:4])  # ahead of any table: not read
    raw += C.ts_tables([0x1B, 0x0F], counters) + b"".join(C.ts_packet(p, [0x1B, 0x0F], counters) for p in first[4:])
    raw += C.ts_cells(0x101, b"\0\0\1\xbe" + bytes(300), counters)  # padding, no packet
    raw += C.ts_tables([0x1B, 0x0F, 0x0F], counters) + b"".join(C.ts_packet(p, [0x1B, 0x0F, 0x0F], counters) for p in rest)
    (tmp_path / "b.m2ts").write_bytes(raw + raw[:100])  # a cell that is cut off
    whole = list(C.parse_ts(raw))
    assert {p.stream_index for p in whole} == {0, 1, 2}
    same(spark, tmp_path / "b.m2ts", whole, [188 * 11, 1 << 20])


def test_lost_synchronisation(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(C.write_ts(made(1, 5), [0x1B]) + bytes(188))
    with pytest.raises(Exception, match="lost synchronisation"):
        packet_index.read(spark, str(tmp_path / "a.ts")).collect()


def test_ivf_and_avi(spark, tmp_path):
    raw = C.write_ivf([(3 * i, bytes([i % 2]) * (i % 50)) for i in range(200)], 16, 8)
    (tmp_path / "a.ivf").write_bytes(raw[:-3])
    same(spark, tmp_path / "a.ivf", list(C.parse_ivf(raw[:-3])), [1000])
    avi = C.write_avi(made(2, 50), [b"vids", b"auds"])
    (tmp_path / "i.avi").write_bytes(avi)
    same(spark, tmp_path / "i.avi", list(C.parse_avi(avi)), [3000])
    bare = avi[: avi.rindex(b"idx1")]
    (tmp_path / "w.avi").write_bytes(bare)
    same(spark, tmp_path / "w.avi", list(C.parse_avi(bare)), [1000])


@pytest.mark.parametrize("suffix", ["webm", "mp4"])
def test_sinks_read_back(spark, tmp_path, suffix):
    rows, table = sent(spark, files=("x", "y"), suffix=suffix)
    options = {"codecs": "V_VP9,A_OPUS", "cluster_ms": "500"} if suffix == "webm" else {"kinds": "vide,soun", "codecs": "vp09,sowt"}
    sinks.write(table, str(tmp_path), suffix, **options)
    for f in "xy":
        with open(tmp_path / f"{f}.{suffix}", "rb") as file:
            whole = list(streams.PARSERS[suffix](file))
        same(spark, tmp_path / f"{f}.{suffix}", whole, [60_000])
    both = packet_index.read(spark, str(tmp_path), 100_000)
    assert both.count() == 120 and both.groupBy("file").count().count() == 2
    assert media.read_media(spark, str(tmp_path / f"x.{suffix}")).count() == 60


@pytest.mark.parametrize("known", [True, False])
def test_matroska_groups_lacing_and_unknown_sizes(spark, tmp_path, known):
    block = lambda flags, body: bytes([0x81]) + struct.pack(">hB", 5, flags) + body
    laced = [b"\x02\x01\x02" + b"abbccc", b"\x01xxyy", b"\x02\x82\xc0" + b"aabbbbb"]
    cluster = lambda t: sinks.number_element(0xE7, t) + sinks.element(0xA0, sinks.element(0xA1, block(0, b"key"))) + sinks.element(0xA0, sinks.element(0xA1, block(0, b"dep")) + sinks.element(0xFB, b"\xff")) + b"".join(sinks.element(0xA3, block(f, b)) for f, b in zip((0x82, 0x04, 0x06), laced, strict=True))
    unknown = b"\x01" + b"\xff" * 7
    clusters = b"".join(sinks.element(0x1F43B675, cluster(t)) if known else (0x1F43B675).to_bytes(4, "big") + unknown + cluster(t) for t in (100, 200, 300))
    head = sinks.element(0x1549A966, sinks.number_element(0x2AD7B1, 2_000_000)) + sinks.element(0x1654AE6B, sinks.element(0xAE, sinks.number_element(0xD7, 1)))
    body = head + clusters + sinks.element(packet_index.CUES, b"cue")
    raw = sinks.element(0x1A45DFA3, b"") + (sinks.element(0x18538067, body) if known else (0x18538067).to_bytes(4, "big") + unknown + body)
    (tmp_path / "a.mkv").write_bytes(raw)
    same(spark, tmp_path / "a.mkv", list(streams.parse_matroska(io.BytesIO(raw))), [100])


def test_conditions_read_only_what_they_need(spark, tmp_path, monkeypatch):
    raw = C.write_ts(made(2, 60), [0x1B, 0x0F])
    (tmp_path / "a.ts").write_bytes(raw)
    whole = list(C.parse_ts(raw))
    got = packet_index.read(spark, str(tmp_path / "a.ts"), 4000, "seq between 10 and 12 and stream_index = 0").orderBy("seq").collect()
    assert [columns(r) for r in got] == [columns(p) for p in whole[10:13] if p.stream_index == 0]
    saved = packet_index.index(spark, str(tmp_path / "a.ts"))
    saved.write.parquet(str(tmp_path / "saved"))  # an index is a table
    again = packet_index.fetch(spark.read.parquet(str(tmp_path / "saved")).filter("keyframe"), 3).count()
    assert again == sum(p.keyframe for p in whole)


def test_long_file_in_many_tasks(spark, tmp_path):
    rnd = random.Random(1)
    packets = [C.Packet(i % 2, 3000 * i, 3000 * i, False, 0, rnd.randbytes(40_000)) for i in range(100)]
    raw = C.write_ts(packets, [0x1B, 0x0F])
    (tmp_path / "long.ts").write_bytes(raw)
    got = packet_index.read(spark, str(tmp_path / "long.ts"), 512 << 10)
    assert got.rdd.getNumPartitions() >= len(raw) // (512 << 10)
    assert sorted(bytes(r.data) for r in got.collect()) == sorted(p.data for p in packets)


def test_empty_and_other_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"no media")
    (tmp_path / "b.ts").write_bytes(b"")
    assert packet_index.read(spark, str(tmp_path)).collect() == []
    (tmp_path / "c.ivf").write_bytes(b"no header at all, whatever its name says")
    with pytest.raises(Exception, match="no IVF file"):
        packet_index.read(spark, str(tmp_path)).collect()
