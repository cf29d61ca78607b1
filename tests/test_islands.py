"""Runs over block edges, command lines as a column, and subtitles on frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.operators import documents, islands, video


@pytest.mark.parametrize("block", [1, 4, 7, 1000])
def test_runs_over_block_edges(spark, block):
    rnd = random.Random(block)
    rows = [(s, i, rnd.random() < 0.8) for s in (0, 1, None) for i in range(60)] + [(2, i, True) for i in range(25)] + [(3, -i, True) for i in range(9)]
    table = spark.createDataFrame(rows, "stream long, i long, quiet boolean").repartition(5)
    for least, drop in ((1, False), (3, True), (26, False)):
        want = set()
        for s in {r[0] for r in rows}:
            places = sorted(i for t, i, q in rows if t == s and q)
            end = max(i for t, i, _ in rows if t == s)
            start = None
            for k, i in enumerate(places):
                start = i if start is None else start
                if k + 1 == len(places) or places[k + 1] != i + 1:
                    if i + 1 - start >= least and not (drop and i + 1 > end):
                        want.add((s, start, i + 1))
                    start = None
        got = islands.islands(table, ["stream"], "i", F.col("quiet"), least, drop, block)
        assert {tuple(r) for r in got.collect()} == want


def test_command_lines_as_a_column(spark):
    lines = ["ffmpeg -y -ss 1:30 -to 00:02:00.5 -i 'a b.mov' -c:v h264 -weird out.mp4", "-i", None, "", "x 'unfinished"]
    rows = spark.createDataFrame(list(enumerate(lines)), "k long, line string").select("k", documents.parse_commands(F.col("line")).alias("j")).orderBy("k").collect()
    one = documents.parse_command(lines[0])
    assert (rows[0].j.inputs, rows[0].j.output, rows[0].j.params, rows[0].j.extra, rows[0].j.seconds) == (one.inputs, one.output, one.params, one.extra, pytest.approx(one.seconds()))
    assert rows[1].j.inputs is None and "needs a value" in rows[1].j.error
    assert rows[2].j.inputs == [] and rows[2].j.output is None and rows[3].j.error is None
    assert rows[4].j.error and rows[4].j.params is None


def test_subtitles_follow_the_cues(spark):
    frames = [(s, n, 40, 20, bytearray(2400)) for s in (0, 1) for n in range(10)]
    cues = [(0, 0, 0, 200, "12"), (0, 1, 100, 300, "7"), (1, 0, 333, 334, "5")]
    made = video.subtitled(spark.createDataFrame(frames, "stream long, frame_no long, width int, height int, data binary"), spark.createDataFrame(cues, "stream long, ordinal long, start_ms long, end_ms long, text string"), 30.0, 0, 0, 1)
    got = {(r.stream, r.frame_no): np.frombuffer(bytes(r.data), np.uint8).reshape(20, 40, 3) for r in made.collect()}
    assert len(got) == 20
    for (s, n), x in got.items():
        ms = int(n * 1000 / 30.0)
        text = " ".join(t for c, _, a, b, t in cues if c == s and a <= ms < b)
        want = np.zeros((20, 40, 3), np.uint8)
        video.draw_text(want, text, 0, 0, 1)
        assert (x == want).all(), (s, n, text)
