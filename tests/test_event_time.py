"""Sessions, repeated rows and joined streams: the stream gives what the batch gives."""

import datetime as dt

from cinelake.streaming import event_time

START = dt.datetime(2024, 1, 1)
PACKETS = "stream long, seq long, ts timestamp, size long"
CUES = "track long, ordinal long, start timestamp, stop timestamp"
SHOWN = "track long, frame_no long, ts timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def source(spark, folder, schema, batches):
    """A stream that reads the batches one by one."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def told(made, name, tmp_path):
    query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"state-{name}")).start()
    query.processAllAvailable()
    query.stop()
    return sorted(tuple(r) for r in made.sparkSession.table(name).collect())


def far(k=10):
    return [(99, 10_000, at(1_000_000 * k), 0)]


def test_sessions(spark, tmp_path):
    times = [(s, 40 * k + (700 if k > 20 else 0) + (3000 if k > 40 and s else 0)) for s in (0, 1) for k in range(60)]
    rows = [(s, n, at(t), n) for n, (s, t) in enumerate(times)]
    want = {}
    for s in (0, 1):
        own, group = sorted(r for r in rows if r[0] == s), []
        for r in own:
            if group and (r[2] - group[-1][2]).total_seconds() >= 300:
                want[s, group[0][2]] = group
                group = []
            group.append(r)
        want[s, group[0][2]] = group
    batch = sorted(tuple(r) for r in event_time.sessions(spark.createDataFrame(rows, PACKETS), "5 minutes").collect())
    assert batch == sorted((s, g[0][2], g[-1][2] + dt.timedelta(minutes=5), len(g), sum(r[3] for r in g)) for (s, _), g in want.items())
    by_time = sorted(rows, key=lambda r: r[2])
    stream = source(spark, tmp_path / "in", PACKETS, [by_time[:50], by_time[50:], far()])
    assert told(event_time.sessions(stream, "5 minutes"), "sessions", tmp_path) == batch
    windows = sorted(tuple(r) for r in event_time.sliding(spark.createDataFrame(rows, PACKETS), "20 minutes", "10 minutes").collect())
    assert sum(w[3] for w in windows) == 2 * len(rows)
    stream = source(spark, tmp_path / "again", PACKETS, [by_time[:50], by_time[50:], far()])
    assert [w for w in told(event_time.sliding(stream, "20 minutes", "10 minutes"), "windows", tmp_path) if w[0] != 99] == windows


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(0, k, at(60 * k), 1) for k in range(30)]
    stream = source(spark, tmp_path / "in", PACKETS, [rows, [(0, 100, at(3600 * 5), 1)], [(0, 101, at(10), 1)], far()])
    got = told(event_time.sessions(stream, "5 minutes"), "late", tmp_path)
    assert [r[3] for r in got if r[0] == 0] == [30, 1]


def test_repeated_packets(spark, tmp_path):
    rows = [(0, k % 25, at(k), k % 25) for k in range(50)]
    batch = sorted((r.stream, r.seq) for r in event_time.unique(spark.createDataFrame(rows, PACKETS), ["stream", "seq"]).collect())
    assert batch == [(0, k) for k in range(25)]
    stream = source(spark, tmp_path / "in", PACKETS, [rows[:30], rows[30:]])
    assert sorted(r[:2] for r in told(event_time.unique(stream, ["stream", "seq"]), "unique", tmp_path)) == batch


def test_cues_of_frames(spark, tmp_path):
    cues = [(t, k, at(10 * k), at(10 * k + 7 + (6 if k % 3 == 0 else 0))) for t in (0, 1) for k in range(12)]
    frames = [(t, n, at(n)) for t in (0, 1, 2) for n in range(130)]
    want = sorted((t, n, k) for t, n, ts in frames for u, k, a, b in cues if t == u and a <= ts < b)
    batch = event_time.cues_of_frames(spark.createDataFrame(frames, SHOWN), spark.createDataFrame(cues, CUES))
    assert sorted(tuple(r) for r in batch.collect()) == want
    by_time = sorted(frames, key=lambda r: r[2])
    made = event_time.cues_of_frames(source(spark, tmp_path / "frames", SHOWN, [by_time[:200], by_time[200:]]), source(spark, tmp_path / "cues", CUES, [cues[:12], cues[12:]]), late="10 minutes")
    assert told(made, "cues", tmp_path) == want
