"""The filter audit against SQL and against filters that are really applied one after the other."""

import random
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from cinelake.llm import filter_audit as fa
from cinelake.llm import registry

from .conftest import TEXTS

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def applied(docs, labels):
    """Each order applied to the rows, step by step."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in range(2))
    failed = []
    for i, t, p in docs:
        t = t or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        failed.append((p or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in failed}:
            left = [f for f in failed if f[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                now = [f for f in left if k in f[1]]
                redundant = sum(k in f[1] for f in gone)
                left = [f for f in left if k not in f[1]]
                shapley[part, k] += len(now)
                out[part, order, step] = [len(left), len(now), redundant, sum(f[1] == {k} for f in failed if f[0] == part), sum(f[2] for f in now), sum(f[3] for f in now)]
                gone += now
    return sorted((part, order, step, *v, shapley[part, order[step - 1]]) for (part, order, step), v in out.items())


@pytest.fixture
def tables(spark, docs):
    rnd = random.Random(1)
    long = ["word%d" % k for k in range(250)]
    extra = [(100 + k, " ".join(long if k % 3 else long[:210] * 2) + rnd.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ"]), rnd.choice(["a", "b", None, ""])) for k in range(40)]
    extra += [(None, extra[0][1], "a"), (7, extra[0][1], "a"), (7, extra[0][1], "a"), (7, extra[0][1], None), (500, "W " * 600_000, "b")]
    rows = [(i, t, f"src{n % 2}") for n, (i, t) in enumerate(TEXTS)] + extra
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, _part string, copies int")
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in [*range(12), *range(100, 140), None, 7, 7]]
    return rows, labels, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_equals_filters_applied(tables):
    rows, labels, docs, known = tables
    assert rows_of(fa.audit(docs, known)) == applied(rows, labels)


def test_audit_equals_sql(tables, tmp_path):
    _, _, docs, known = tables
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    db.register("labels", known.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert rows_of(fa.audit(docs, known)) == sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({fa.ORACLE_SQL})").fetchall())


def test_without_rows_or_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(empty, labels).collect() == []
    out = fa.audit(docs, labels).collect()
    assert len(out) == 2 * 600 and all(r.good_lost == r.toxic_lost == 0 for r in out)


def test_positional_popcounts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 64, 1000, 4099):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        copies = rng.integers(0, 1000, n)
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        assert np.array_equal(fa.positional_popcount(words), bits.sum(axis=0))
        assert np.array_equal(fa.weighted_popcount(words, copies), (bits * copies[:, None]).sum(axis=0))


def test_many_parts_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(fa, "HELD_PARTS", 3)
    docs = spark.createDataFrame([(k, "text", f"p{k}") for k in range(50)] * 2, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    out = fa.audit(docs, labels).filter("filter_order = 'ABCDE' and step = 1").collect()
    assert len(out) == 50 and all(r.removed == 2 for r in out) and [r.part for r in out if r.good_lost] == ["p3"]


def test_query_equals_sql_on_given_tables(spark):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert rows_of(registry.op12_filter_audit(spark, d)) == sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({registry.oracle_sql()['op12_filter_audit']})").fetchall())
