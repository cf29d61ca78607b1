"""Growing files and segment packages over restarts and killed micro-batches, against their batch forms."""

import os
import shutil

import pytest

from cinelake.operators import control
from cinelake.sources import containers as C
from cinelake.sources import packages
from cinelake.streaming import packet_source, segment_sink
from tests.test_containers import made

COLUMNS = "file string, stream_index int, seq bigint, pts bigint, dts bigint, keyframe boolean, position bigint, size int, data binary"


def follow(spark, folder, out, state, size=1 << 20):
    """One run of a query that is started anew, until it has caught up."""
    rows = packet_source.read_stream(spark, str(folder), range_bytes=str(size)).drop("duration")
    query = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted((r.file.rsplit("/", 1)[-1], r.stream_index, r.seq, r.pts, r.dts, r.keyframe, r.position, bytes(r.data)) for r in spark.read.schema(COLUMNS).parquet(str(out)).collect())


@pytest.mark.parametrize("size", [188 * 20])
def test_growing_files_arrive_once(spark, tmp_path, size):
    (tmp_path / "in").mkdir()
    ts = C.write_ts(made(2, 50, 3), [0x1B, 0x0F])
    ivf = C.write_ivf([(2 * i, bytes([i % 2]) * (i + 1)) for i in range(40)], 4, 4)
    y4m = b"YUV4MPEG2 W2 H2 F25:1 Cmono\n" + b"".join(b"FRAME\n" + bytes([i]) * 4 for i in range(20))
    whole = {"a.ts": list(C.parse_ts(ts, flush=False)), "b.ivf": list(C.parse_ivf(ivf))}
    for part in (0.0, 0.013, 0.4, 0.41, 1.0):  # cut anywhere, within heads and packets
        for name, raw in (("a.ts", ts), ("b.ivf", ivf), ("c.y4m", y4m)):
            (tmp_path / "in" / name).write_bytes(raw[: int(len(raw) * part)])
        got = follow(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", size)
    assert sorted(r[2:] for r in got if r[0] == "a.ts") == sorted((p.position, p.pts, p.dts, p.keyframe, p.position, p.data) for p in whole["a.ts"])
    assert {r[1] for r in got if r[0] == "a.ts"} == {0, 1}
    assert [r[2:] for r in got if r[0] == "b.ivf"] == [(n, p.pts, p.dts, p.keyframe, p.position, p.data) for n, p in enumerate(whole["b.ivf"])]
    assert [(r[2], r[7]) for r in got if r[0] == "c.y4m"] == [(i, bytes([i]) * 4) for i in range(20)]
    assert follow(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state") == got  # nothing new


PACKETS = "stream long, stream_index int, seq long, pts long, dts long, size long, keyframe boolean, data binary"


def recorded(streams=3, n=60):
    """Packets of several streams, with reordered times."""
    rows = []
    for s in range(streams):
        for p, k in zip(made(1, n, s), range(n), strict=True):
            pts = 400 * k + (300 if k % 3 == 1 else 0)
            rows.append((s, 0, k, pts, 400 * k, len(p.data), k % 7 == 0 and k % 2 == 0, bytearray(p.data)))
    return rows


def contents(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc") and "_log" not in d}


def batches(spark, folder, rows, times):
    """A file per micro-batch; the streams' packets in order, then the rows that end them."""
    ends = [(s, None, 10_000, None, None, None, None, None) for s in {r[0] for r in rows}]
    step = -(-60 // times)
    for b in range(times + 1):
        part = [r for r in rows if r[2] // step == b] if b < times else ends
        spark.createDataFrame(part, PACKETS).coalesce(1).write.parquet(str(folder / f"b{b}"))
    (folder / "all").mkdir()
    for b in range(times + 1):
        for f in os.listdir(folder / f"b{b}"):
            if f.endswith(".parquet"):
                shutil.copy(folder / f"b{b}" / f, folder / "all" / f"{b}.parquet")
                os.utime(folder / "all" / f"{b}.parquet", (1_700_000_000 + b, 1_700_000_000 + b))


def package(spark, source, folder, state):
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = segment_sink.write_segments(stream, str(folder), str(state), 3000, 9000, once=True)
    query.awaitTermination(180)


@pytest.fixture(scope="module")
def made_in_batch(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("package")
    rows = recorded()
    batches(spark, root, rows, 5)
    profiles = spark.createDataFrame([(0, "a", 16, 9, 1000)], "ordinal int, name string, width int, height int, bits long")
    table = spark.createDataFrame(rows, PACKETS)
    documents = packages.hls_package(table, str(root / "batch"), 3000, 9000, profiles, kinds="0x1B")
    assert documents.count() == 4
    return root, {k: v for k, v in contents(root / "batch").items() if k != "master.m3u8"}, table


def test_stream_gives_the_batch_package(spark, tmp_path, made_in_batch):
    root, want, _ = made_in_batch
    assert len(want) > 12
    package(spark, root / "all", tmp_path / "out", tmp_path / "state")
    assert contents(tmp_path / "out") == want


@pytest.mark.parametrize("killed", ["before its files have names", "before it is logged"])
def test_killed_micro_batch(spark, tmp_path, made_in_batch, killed):
    root, want, _ = made_in_batch
    (tmp_path / "some").mkdir()
    for b in range(4):
        shutil.copy2(root / "all" / f"{b}.parquet", tmp_path / "some" / f"{b}.parquet")
    package(spark, tmp_path / "some", tmp_path / "out", tmp_path / "state")
    before = contents(tmp_path / "out")
    last = max(int(f) for f in os.listdir(tmp_path / "state" / "commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        os.remove(tmp_path / "state" / "commits" / f)
    if killed.startswith("before its files"):
        for s in range(3):
            newest = max(f for f in before if f.startswith(f"{s}/segment"))
            shutil.move(tmp_path / "out" / newest, tmp_path / "out" / f"{newest}.9-99.part")
            (tmp_path / "out" / f"{s}" / "media.m3u8").write_bytes(b"old")
    for b in range(4, 6):
        shutil.copy2(root / "all" / f"{b}.parquet", tmp_path / "some" / f"{b}.parquet")
    package(spark, tmp_path / "some", tmp_path / "out", tmp_path / "state")
    assert contents(tmp_path / "out") == want


def test_segments_by_number_and_not_by_time(spark, made_in_batch):
    """Files and playlists agree where times do not rise."""
    _, want, table = made_in_batch
    numbers = control.segment_numbers(table, 3000, 9000)
    made_ = {(r.stream, r.segment): tuple(r)[2:] for r in control.segments(table, 3000, 9000).select("stream", "segment", "start", "duration", "size", "packets").collect()}
    assert {(r.stream, r.segment): tuple(r)[2:] for r in control.segments_of(numbers).select("stream", "segment", "start", "duration", "size", "packets").collect()} == made_
    for (s, k), (_, _, size, n) in made_.items():
        packets = list(C.parse_ts(want[f"{s}/segment_{k:05d}.ts"]))
        assert (len(packets), sum(len(p.data) for p in packets)) == (n, size)


def test_playlist_text(spark):
    segments = spark.createDataFrame([(1, k, 1000 * k, 1000 + 7 * k, 5, 1) for k in range(12)], "stream long, segment int, start long, duration long, size long, packets long")
    for vod in (True, False):
        want = control.media_playlist(segments, 6, vod).first()["playlist"]
        assert control.playlist_text([(k, 1000 + 7 * k) for k in range(12)], 6, vod) == want
