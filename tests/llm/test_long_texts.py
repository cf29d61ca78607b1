"""Texts of more than a megabyte go through whole."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinelake.llm import bpe, imatch, licenses, minhash, packing, quality, token_counts, toxicity, windows

from .conftest import make

WORDS = ["river", "stone", "Walking", "over", "bright", "quiet", "garden", "seven", "machine", "under"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    long = " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "er", ".", "\n"]) for _ in range(180_000))
    assert len(long.encode()) > 1_100_000
    return [long, long + " and a few words more at the end", "a short text of some words here", None, long[:600_000] + " Released under the MIT License. " + long[600_000:]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts)


def test_tokens(spark, docs, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs).collect()}
    ids = library.encode(texts[0], add_special_tokens=False).ids
    assert rows[0].n_tokens == len(ids) and rows[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert rows[0].decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
    assert {r.doc_id: r.n_tokens for r in token_counts.lengths(docs).collect()} == {i: r.n_tokens for i, r in rows.items()}
    word = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    word.no_truncation()
    for made in (packing.pack(docs), windows.pack_windows(docs)):
        total = {}
        for r in made.collect():
            assert 0 < r.length <= 2048
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert total == {i: len(word.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_fingerprints_and_near_duplicates(docs, texts):
    rows = {r.doc_id: r for r in imatch.fingerprint_pairs(docs).collect()}
    assert {i: r.n_chars for i, r in rows.items()} == {i: len(t or "") for i, t in enumerate(texts)}
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}


def test_scores(spark, docs, texts):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    counts = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(counts[i].n_words == len((t or "").split()) and counts[i].word_chars == sum(map(len, (t or "").split())) for i, t in enumerate(texts))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, labels).collect())


def test_license_in_the_middle(docs):
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {0: "", 1: "", 2: "", 3: "", 4: "mit"}
