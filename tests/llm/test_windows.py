"""Packing by window cuts against the quadratic program and the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinelake.llm import packing, registry, windows

from .conftest import make


def cost_of(cuts, fee, capacity):
    return sum(windows.padding(b - a, capacity) + fee[b] for a, b in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("capacity", [16, 24, 64])
def test_cuts_equal_quadratic_program(capacity):
    rnd = random.Random(capacity)
    for _ in range(60):
        at = np.cumsum([0] + [rnd.randint(1, min(capacity, 9)) for _ in range(rnd.randint(0, 60))])
        penalty = np.array([0] + [rnd.choice([0, 1, 4]) for _ in at[1:]])
        fee = dict(zip(at.tolist(), penalty.tolist()))
        best = {0: (0, 0)}
        for j in at[1:].tolist():
            best[j] = min((best[i][0] + windows.padding(j - i, capacity) + fee[j], best[i][1] + 1) for i in at.tolist() if i < j and j - i <= capacity)
        cuts = windows.best_cuts(at, penalty, capacity)
        assert cuts[0] == 0 and cuts[-1] == at[-1] and set(cuts) <= set(at.tolist())
        assert (cost_of(cuts, fee, capacity), len(cuts) - 1) == best[int(at[-1])]


def test_candidates():
    at, fee = windows.candidates(np.array([10, 400]), np.array([3, 10, 20]), 2048, 128, 4, 32)
    assert dict(zip(at.tolist(), fee.tolist())) == {0: 0, 3: 4, 10: 0, 20: 4, 148: 32, 276: 32, 400: 0}
    at, _ = windows.candidates(np.array([5000]), np.array([], int), 64, 128, 4, 32)
    assert np.diff(at).max() <= 64


def check(docs, packed, capacity, ids_of):
    """Every id in one piece, windows gapless, within the capacity and in the order of the rows of a task."""
    rows = packed.collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for w in by_window.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == [sum(x.length for x in w[:k]) for k in range(len(w))]
        assert 0 < sum(r.length for r in w) <= capacity
    for doc, text in docs:
        ids = ids_of(text)
        own = sorted(by_doc.pop(doc), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert [r.sequence_id for r in own] == sorted(r.sequence_id for r in own)
    assert not by_doc
    return {k: sum(r.length for r in w) for k, w in by_window.items()}


@pytest.fixture(scope="module")
def ids_of():
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("capacity", [64, 100, 2048])
def test_odd_texts(spark, docs, ids_of, capacity):
    distinct = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check([(r.doc_id, r.text) for r in distinct.collect()], windows.pack_windows(distinct, capacity=capacity), capacity, ids_of)
    everything = windows.pack_windows(docs, capacity=capacity).collect()
    assert sum(r.length for r in everything) == sum(len(ids_of(r.text)) for r in docs.collect())
    assert any(r.doc_id is None for r in everything)


def test_empty_and_ids(spark, empty, ids_of):
    assert windows.pack_windows(empty).collect() == []
    assert windows.pack_windows(empty, keep_ids=True).schema["ids"].dataType.simpleString() == "array<int>"
    texts = ["One sentence. Another one! " * 40, None, "", "no end at all " * 300, "x" * 1_200_000]
    frame = make(spark, texts).coalesce(1)
    whole = packing.sequences(windows.pack_windows(frame, capacity=256, keep_ids=True)).orderBy("sequence_id").collect()
    assert [i for r in whole for i in r.ids] == [i for t in texts for i in ids_of(t)]  # the order of the rows
    assert all(len(r.ids) == r.n_tokens <= 256 for r in whole)


def test_cuts_prefer_sentences(spark, ids_of):
    texts = [" ".join(f"word number {k} of the sentence {n}." for k in range(60)) for n in range(40)]
    packed = windows.pack_windows(make(spark, texts).coalesce(1))
    ends = {i for i, b in enumerate(windows.ending_tokens(windows.codec("word_bpe_49k.json"), "word_bpe_49k.json")) if b}
    inner = [r for r in packed.collect() if r.start]
    assert inner and all(ids_of(texts[r.doc_id])[r.start - 1] in ends for r in inner)


def test_query_on_given_table(spark, ids_of):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    fills = check(docs, registry.op11_window_packing(spark, d), 2048, ids_of)
    assert sum(windows.padding(f, 2048) for f in fills.values()) <= 0.01 * sum(fills.values())
