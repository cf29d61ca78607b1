"""Encoding, decoding, packing and token counts, against the tokenizers library and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cinelake.llm import bpe, packing, token_counts

ALPHABET = "ab cdEF'st \n\t  é ß Σς 漢字 12½   \x1c\x85.,!<|endoftext|> İ 🎉"


def random_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "<|endoftext|>", "cat's", "Don't", "é", "ing", "12", "3,4", "ΑΣ"]
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_equals_library(name):
    texts = random_texts(1, 300) + ["", " ", "a" * 500, "x  ", "  x", "<|endoftext|>"]
    own, library = bpe.Codec(public_tokenizers.path(name)), Tokenizer.from_file(str(public_tokenizers.path(name)))
    for _ in range(2):  # the second time from the cache
        ids, offsets = own.encode_column(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_cache_bound_changes_nothing():
    texts = random_texts(2, 100)
    small = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    small.CACHE = 3
    big = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    for part in (texts[:50], texts[50:]):
        a, b = (c.encode_column(pa.array(part, pa.string())) for c in (small, big))
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_round_trip(docs):
    coded = bpe.encode(docs)
    assert coded.columns == ["doc_id", "ids"]
    back = Counter((r.doc_id, r.text) for r in bpe.decode(coded).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in docs.collect())
    digests = bpe.round_trip_digests(docs).collect()
    assert len(digests) == docs.count()


def test_decode_of_broken_utf8():
    c, library = bpe.codec("byte_bpe_50k.json"), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = library.encode("漢字é", add_special_tokens=False).ids[:-1]
    assert c.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def check_packing(docs, packed, capacity):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], dtype="<u4")
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(docs, empty):
    used, least = check_packing(docs, packing.pack(docs, capacity=256), 256)
    assert used <= least + 1
    assert packing.pack(empty).count() == 0


def test_packing_over_blocks_and_sequences(spark):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, "cat " * rnd.randint(0, 40)) for i in range(600)], "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, capacity=64, block=50, keep_ids=True)
    used, least = check_packing(docs, packed, 64)
    assert used <= least * 1.03 + 2
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and all(len(r.ids) == r.n_tokens for r in whole)


def triples(seed, bins, capacity=1000):
    """Pieces that fill bins of three without any room, which best fit does not find."""
    rnd = random.Random(seed)
    out = []
    for _ in range(bins):
        a = rnd.randint(380, 490)
        b = rnd.randint((capacity - a) // 2 - 60, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rnd.shuffle(out)
    return out


def test_genetic_packing_saves_bins_over_best_fit():
    saved = 0
    for seed in range(5):
        sizes = triples(seed, 30)
        bins, rooms = packing.pack_block(sizes, 1000, seed)
        first, _ = packing.best_fit(sorted(range(90), key=lambda i: -sizes[i]), sizes, 1000)
        assert 30 <= len(bins) <= len(first)
        saved += len(first) - len(bins)
        assert sorted(i for b in bins for i in b) == list(range(90))
        assert all(sum(sizes[i] for i in b) + r == 1000 and r >= 0 for b, r in zip(bins, rooms, strict=True))
    assert saved >= 5


def test_islands_save_bins_and_elites_migrate(spark):
    blocks = {k: triples(10 + k, 30) for k in range(3)}
    frame = spark.createDataFrame(list(blocks.items()), "_block long, _sizes array<int>")
    used = {}
    for epochs in (1, 3):
        rows = packing.search_islands(frame, 1000, 3, epochs, 20, 4).collect()
        assert len(rows) == 3
        for r in rows:
            bins, rooms = packing.solution_of(r["_bins"], blocks[r["_block"]], 1000)
            assert sorted(i for g in bins for i in g) == list(range(90)) and min(rooms) >= 0
            used[epochs, r["_block"]] = packing.fitness((bins, rooms), 1000)
    first = {k: len(packing.best_fit(sorted(range(90), key=lambda i: -s[i]), s, 1000)[0]) for k, s in blocks.items()}
    assert all(used[3, k] <= used[1, k] for k in blocks) and any(used[3, k] < used[1, k] for k in blocks)
    assert sum(first.values()) - sum(used[3, k][0] for k in blocks) >= 3


def test_all_underfilled_bins_are_searched():
    """Many more pieces than a search has before it at once: each group is worked off, and bins are saved in most."""
    sizes = triples(3, 300)
    first = packing.decreasing(sizes, 1000)
    rng = random.Random(1)
    groups = packing.groups_of(first, sizes, 1000, 0, rng, 90)
    under = {k for k, room in enumerate(first[1]) if room}
    left_out = under - {k for g in groups for k in g}
    assert len(groups) > 5 and len(left_out) < 0.2 * len(under)
    bins, rooms = packing.pack_block(sizes, 1000, 1, slack=0, searched=90)
    assert sorted(i for b in bins for i in b) == list(range(900)) and min(rooms) >= 0
    assert len(bins) <= len(first[0]) - 5
    assert packing.pack_block(sizes, 1000, 1, generations=0) == first


def test_packing_beats_best_fit_over_a_table(spark):
    """Texts whose lengths in tokens fill sequences in threes: the search of ``pack`` uses fewer than best fit alone."""
    sizes = [n - 1 for n in triples(21, 40)]
    frame = spark.createDataFrame([(k, " ".join(["a"] * n)) for k, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    used = {}
    for generations in (0, 20):
        packed = packing.pack(frame, capacity=1000, slack=0, generations=generations)
        rows = packed.collect()
        assert sum(r.length for r in rows) == sum(sizes) + len(sizes)
        used[generations] = len({r.sequence_id for r in rows})
    assert 40 <= used[20] < used[0]


def test_crossover_keeps_every_document():
    sizes = [random.Random(i).randint(1, 50) for i in range(120)]
    a = packing.best_fit(list(range(120)), sizes, 64)
    b = packing.best_fit(list(range(119, -1, -1)), sizes, 64)
    for seed in range(5):
        bins, rooms = packing.crossover(a, b, sizes, 64, random.Random(seed))
        assert sorted(i for g in bins for i in g) == list(range(120))
        assert all(sum(sizes[i] for i in g) + r == 64 and r >= 0 for g, r in zip(bins, rooms, strict=True))


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    n = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    hist = token_counts.histogram(token_counts.lengths(docs))
    for r in hist.collect():
        assert r.n_docs == n.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in n)
        assert r.share_at_most == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    assert token_counts.quantile(hist, 0.5).first().n_tokens == sorted(n)[(len(n) + 1) // 2 - 1]
    assert token_counts.histogram(token_counts.lengths(empty)).count() == 0


def test_truncated_totals_for_any_limit(spark, docs, empty):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    n = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    limits = [0, 1, 5, 13, 13, 1023, 1024, 1500, 3000, 10**7, None]
    asked = spark.createDataFrame([(x,) for x in limits], "limit long")
    rows = token_counts.truncated(token_counts.histogram(token_counts.lengths(docs)), asked).collect()
    assert sorted(r.limit for r in rows) == sorted({x for x in limits if x is not None})
    for r in rows:
        assert (r.docs_over, r.docs_within, r.total) == (sum(x > r.limit for x in n), sum(x <= r.limit for x in n), sum(min(x, r.limit) for x in n))
    none = token_counts.truncated(token_counts.histogram(token_counts.lengths(empty)), asked).collect()
    assert len(none) == 9 and all((r.docs_over, r.docs_within, r.total) == (0, 0, 0) for r in none)


def test_counting_encodes_once(docs):
    plan = token_counts.histogram(token_counts.lengths(docs))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the histogram is written; what follows reads it
