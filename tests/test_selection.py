"""Selections whose rules show at edges only."""

import math

import pytest

from cinelake.operators import catalog, selection
from pyspark.sql import functions as F


def stream(spark, scores):
    return spark.createDataFrame([(0, i, s, i * 0.5) for i, s in enumerate(scores)], "stream long, frame_no long, score long, time double")


@pytest.mark.parametrize("length", [1, 3, 7, 10, 25])
def test_uniform_steps(spark, length):
    got = sorted(r.frame_no for r in selection.uniform(stream(spark, [0] * length), 5).collect())
    kept = min(length, 10)
    assert got == [i for i in (math.floor(k * max(kept / 5, 1.0)) for k in range(5)) if i < kept]


def test_adaptive_is_the_streaming_rule(spark):
    scores = [3, 9, 1, 8, 2, 9, 7, 8, 1, 9, 5, 8]
    buffer = []
    for i, s in enumerate(scores):
        if s >= 7 or len(buffer) < 2:
            buffer.append((i, s))
        if len(buffer) > 4:
            buffer.sort(key=lambda x: -x[1])
            buffer = buffer[:4]
    got = {r.frame_no for r in selection.adaptive(stream(spark, scores), 7, 2, 4).collect()}
    assert got == {i for i, _ in buffer}


def test_lists_that_do_not_compare(spark):
    row = spark.createDataFrame([([1, 2], [1], [], [])], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    got = row.select(selection.list_distance(F.col("a"), F.col("b")).alias("x"), selection.list_similarity(F.col("a"), F.col("b")).alias("y"), selection.list_similarity(F.col("c"), F.col("d")).alias("z"), selection.list_similarity(F.col("a"), F.col("a")).alias("w")).first()
    assert got.x is None and got.y == 0.0 and math.isnan(got.z) and got.w == 1.0


def test_thumbnails(spark):
    rows = stream(spark, [5, 9, 9, 1])
    one = lambda *a: selection.thumbnail(rows, *a).first().frame_no
    assert [one("first"), one("middle"), one("timestamp", 0.25), one("timestamp", 9), one("index", 3), one("smart")] == [0, 2, 0, 3, 3, 2]
    with pytest.raises(Exception, match="no frame 4"):
        one("index", 4)
    with pytest.raises(ValueError):
        one("guess")


def test_catalog_edges(spark):
    assert catalog.codecs(spark, "anything").count() == 7 and catalog.codecs(spark, "video").count() == 4
    files = spark.createDataFrame([("a/b.MKV",), ("c.xyz",)], "path string")
    assert {r.path: r.name for r in catalog.with_format(files, spark).collect()} == {"a/b.MKV": "matroska", "c.xyz": None}
    tags = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in tags.select(catalog.merge_tags(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "3"}, {}]
