"""Connected components over link tables of any size, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, shared_checkpoint


def union_find(a: list[int], b: list[int]) -> dict[int, int]:
    """The least member of the component of each end of the links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def components(links: DataFrame) -> DataFrame:
    """``_v long, _c long``: each end of the links ``_a, _b`` with the least end reachable from it.

    Union-find contracts the links of each partition to stars; least labels then spread over the stars, with a
    jump to the label's own label in each round, until no label changes (a logarithmic number of rounds).
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            a += column_of(batch, "_a").to_pylist()
            b += column_of(batch, "_b").to_pylist()
            if len(a) > 1_000_000:  # bounded memory: a star has a link less than it has members
                stars = union_find(a, b)
                a, b = list(stars), list(stars.values())
                if len(a) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["_a", "_b"])
                    a, b = [], []
        stars = union_find(a, b)
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(list(stars), pa.int64()), pa.array(list(stars.values()), pa.int64())], ["_a", "_b"])

    stars = links.select("_a", "_b").mapInArrow(contract, "_a long, _b long")
    # A vertex has one root per partition at most.  It keeps the least, and so do its other roots: no more links
    # than vertices and pairs of roots go on.
    roots = stars.groupBy("_a").agg(F.collect_set("_b").alias("_s"))
    roots = roots.select(F.explode(F.array_union(F.array("_a"), "_s")).alias("_a"), F.array_min("_s").alias("_b"))
    stars = shared_checkpoint(roots.distinct())
    both = stars.filter("_a <> _b")
    both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    labels = stars.groupBy(F.col("_a").alias("_v")).agg(F.min("_b").alias("_c"))
    while True:
        near = both.join(labels, F.col("_a") == F.col("_v")).select(F.col("_b").alias("_v"), "_c", F.lit(False).alias("_own"))
        spread = near.unionByName(labels.withColumn("_own", F.lit(True))).groupBy("_v").agg(F.min("_c").alias("_n"), F.min(F.when(F.col("_own"), F.col("_c"))).alias("_old"))
        to = spread.select(F.col("_v").alias("_n"), F.col("_n").alias("_m"))
        jumped = spread.join(to, "_n").select("_v", F.col("_m").alias("_c"), "_old")
        jumped = shared_checkpoint(jumped)
        labels = jumped.select("_v", "_c")
        if jumped.filter("_c <> _old").isEmpty():
            return labels


def links_within(matrix_links: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest, as stars, of the links given as pairs of positions."""
    stars = union_find(ids[matrix_links[:, 0]].tolist(), ids[matrix_links[:, 1]].tolist())
    pairs = [(x, root) for x, root in stars.items() if x != root]
    return [x for x, _ in pairs], [r for _, r in pairs]
