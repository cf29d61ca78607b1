"""Line, near-duplicate and suffix deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cinelake.llm import graph, lines, minhash, suffixes

from .conftest import make

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    out = Counter()
    for i, t in rows:
        split = (t or "").split("\n")
        gone = lambda x: i is not None and len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i  # noqa: B023, E731
        kept = [x for x in split if not gone(x)]
        out[i, len(split), len(split) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(docs, empty):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(docs).collect())
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    carried = lines.dedup_lines(docs, carry=("lang", "_id"))
    assert carried.columns == ["doc_id", "n_lines", "n_dropped", "kept", "lang", "_id"]
    assert {r["_id"] for r in carried.collect()} == set(range(14))
    assert lines.dedup_lines(empty).count() == 0


def test_cuckoo_filter_insert_lookup_delete():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    f = lines.CuckooFilter(6000)
    assert f.insert(keys) and f.contains(keys).all()
    other = rng.integers(2**63, 2**64 - 1, 5000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:2000])
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01
    assert not lines.CuckooFilter(16).insert(keys)


def test_shard_counts_are_exact_and_reversible():
    shard, want = lines.Shard(), Counter()
    rnd = random.Random(1)
    digests = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    for _ in range(6):
        some = [rnd.choice(digests) for _ in range(2000)]
        shard.insert(some, [1] * 2000, list(range(2000)), list(range(2000)))
        want.update(some)
    assert {k: v[0] for k, v in shard.table.items()} == want
    assert shard.skipped > 0
    for d in rnd.sample(sorted(want), 1500):
        n = rnd.randint(1, want[d])
        shard.delete([d], [n])
        want[d] -= n
    assert {k: v[0] for k, v in shard.table.items()} == {k: n for k, n in want.items() if n}


def test_line_index_adds_and_deletes(spark, tmp_path):
    first = make(spark, ["one shared line here\nonly in the first", "one shared line here", "third has its own line"])
    more = spark.createDataFrame([(7, "third has its own line\none shared line here")], "doc_id long, text string")
    index = lines.LineIndex(spark, str(tmp_path / "index"), shard_keys=1)
    table = lambda: {bytes(r["_key"]): (r["_refs"], r["_least"], r["_most"]) for r in index.counts().collect()}
    index.update(added=first)
    before = table()
    index.update(added=more)
    assert table()[lines.line_key(b"one shared line here")] == (3, 0, 7)
    index.update(removed=more)
    assert table() == before
    index.update(added=first)  # what is there changes nothing
    assert table() == before
    index = lines.LineIndex(spark, str(tmp_path / "index"))  # a driver that starts anew
    assert table() == before and index.version == 3
    index.update(added=more)
    assert table()[lines.line_key(b"one shared line here")] == (3, 0, 7)
    (tmp_path / "index" / "v4" / "counts" / "_SUCCESS").unlink()  # an update that did not end
    index = lines.LineIndex(spark, str(tmp_path / "index"))
    assert table() == before and index.version == 3
    index.update(removed=first)
    assert table() == {} and lines.LineIndex(spark, str(tmp_path / "index")).version == 4


def test_partitions_are_worked_off_in_shards(spark):
    texts = [f"line number {i % 700} of some length\nanother line {i}" for i in range(2000)]
    table = lambda **k: {bytes(r["_key"]): tuple(r)[1:] for r in lines.reference_counts(lines.id_text(make(spark, texts)), **k).collect()}
    whole = table()
    assert len(whole) == 2700 and table(shard_keys=50) == whole
    assert table(shard_keys=50, least_holders=2) == {k: v for k, v in whole.items() if v[1] < v[2]}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t, width)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts(seed, groups, size):
    rnd = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([2, 5, 60, 120]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9999)}"
            out.append(" ".join(words))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 1024), (5, 80, 7)])
def test_near_duplicates(spark, width, percent, block):
    texts = [*near_texts(width, 12, 15), "", None, "one", "one", "one two"]
    rows = minhash.near_duplicates(make(spark, texts), width, percent, block=block).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(texts) and got == brute_components(list(enumerate(texts)), width, percent)


def test_near_duplicates_of_repeated_ids(spark):
    """Each row of a repeated id has its own text's component."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(3, one), (5, one + " x"), (5, two), (5, two), (9, two + " y"), (7, three), (None, one)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table, 3, 85).collect())
    assert got == Counter([(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (9, 5, False), (7, 7, True), (None, None, True)])


def test_large_component_meets_strangers(spark):
    """Copies around one text, a chain that leaves it step by step, and a stranger that is near its outer copies only."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        words[2 * k % 120] = f"x{k}"
        texts.append(" ".join(words))
    for k in range(12):
        texts.append(" ".join(base[3 * k :] + [f"tail{i}" for i in range(3 * k)]))
    rnd.shuffle(texts)
    rows = minhash.near_duplicates(make(spark, texts), 3, 85, block=8).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got == brute_components(list(enumerate(texts)), 3, 85)


@pytest.mark.parametrize("block", [4, 1024])
def test_block_links_find_every_link_between_components(spark, block):
    rnd = random.Random(block)
    sets = []
    for g in range(3):
        base = sorted(rnd.sample(range(1000 * g, 1000 * g + 400), 50))
        for _ in range(30):
            own = set(base)
            for _ in range(rnd.randint(0, 5)):
                own.discard(rnd.choice(base))
                own.add(rnd.randint(1000 * g + 400, 1000 * g + 420))
            sets.append((g, np.array(sorted(own), np.uint64)))
    comps = [rnd.choice([g * 100, g * 100, g * 100, 1000 + i]) for i, (g, _) in enumerate(sets)]
    members = spark.createDataFrame([(i, g, comps[i], len(x)) for i, (g, x) in enumerate(sets)], "_v long, _g long, _c long, _n long")
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, (_, x) in enumerate(sets)], "_v long, _set binary")
    links = {(r["_a"], r["_b"]) for r in minhash.block_links(members, held, 85, block, 10**6).collect()}
    alike = lambda i, j: 100 * len(np.intersect1d(sets[i][1], sets[j][1])) >= 85 * len(np.union1d(sets[i][1], sets[j][1]))
    own = [(i, comps[i]) for i in range(len(sets))]
    joined = lambda more: graph.union_find([a for a, _ in more] + [i for i, _ in own], [b for _, b in more] + [10_000 + c for _, c in own])
    want = joined([(i, j) for i in range(len(sets)) for j in range(i) if sets[i][0] == sets[j][0] and comps[i] != comps[j] and alike(i, j)])
    got = joined(sorted(links))
    assert {i: got[i] for i in range(len(sets))} == {i: want[i] for i in range(len(sets))}


def test_near_duplicate_edge_cases(docs, empty):
    rows = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(empty).count() == 0


def test_super_minhash_is_the_sequential_algorithm():
    rng = np.random.default_rng(1)
    slots = 32

    def slow(elements):
        h = [2**64 - 1] * slots
        for e in elements.tolist():
            p = list(range(slots))
            for j in range(slots):
                r = int(minhash.mix64(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
                k = j + ((r & (2**32 - 1)) * (slots - j) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], (j << 32) + (r >> 32))
        return h

    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 200)]
    assert minhash.super_minhash(sets, slots).tolist() == [slow(s) for s in sets]


def test_super_minhash_estimates_better_than_minhash():
    rng = np.random.default_rng(2)
    error = []
    for _ in range(60):
        base = rng.integers(0, 2**62, 60).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate([base[:40], rng.integers(2**62, 2**63, 20).astype(np.uint64)]))
        h = minhash.super_minhash([a, b], 64)
        error.append((h[0] == h[1]).mean() - 0.5)
    assert np.sqrt(np.mean(np.square(error))) < np.sqrt(0.25 / 64)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000)]
    frame = spark.createDataFrame(links, "_a long, _b long").repartition(7)
    got = {r["_v"]: r["_c"] for r in graph.components(frame).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 5000: 5000}
    assert graph.components(frame.limit(0)).count() == 0


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, bytes(x for x, m in zip(b, mark, strict=True) if not m)))
    return out


def passage_texts(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé ") for _ in range(400)) for _ in range(5)]
    texts = ["", None, "x", "a" * 400, "ab" * 200, "é" * 150]
    for _ in range(40):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, 300)
            t += rnd.choice(base)[i : i + rnd.randint(20, 150)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 90)))
        texts.append(t)
    return texts


@pytest.mark.parametrize("bounds", [{}, {"shard_segments": 3, "shard_bytes": 2000}])
def test_suffix_dedup(spark, bounds):
    texts = passage_texts(7)
    rows = sorted(suffixes.remove_repeats(make(spark, texts), 60, **bounds).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == brute_spans(texts, 60)


def test_suffix_dedup_edge_cases(docs, empty):
    rows = suffixes.remove_repeats(docs, 40, carry=("_id",)).collect()
    want = brute_spans([r.text for r in docs.collect()], 40)
    assert {r["_id"]: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == dict(enumerate(want))
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for n, most in ((1, 3), (200, 2), (500, 4), (300, 1)):
        text = rng.integers(0, most, n).astype(np.uint8)
        order, at = suffixes.suffix_array(text)
        raw = text.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        assert (order[at] == np.arange(n)).all()
        got = suffixes.common_prefixes(text, order, at, np.array([0]), np.array([n]), 10**6)
        for place in range(1, n):
            a, b = raw[order[place - 1] :], raw[order[place] :]
            assert got[place] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("unit", ["a", "ab", "abcdefghij" * 30])
def test_suffix_dedup_of_runs(spark, unit):
    """Ten million bytes of one character or a short period are a few rows and go whole; so does a longer period."""
    size = 10_000_000 if len(unit) < 3 else 60_000
    texts = [unit * (size // len(unit)), "x" * 150 + unit * (400 // len(unit)) + "y" * 150, "".join(map(chr, range(1000, 1400)))]
    rows = sorted(suffixes.remove_repeats(make(spark, texts)).collect())
    assert (rows[0].n_bytes, rows[0].n_removed, rows[0].n_spans, bytes(rows[0].kept)) == (len(texts[0]), len(texts[0]), 1, b"")
    want = brute_spans([unit * (3000 // len(unit)), *texts[1:]], 200)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows[1:]] == want[1:]


def test_suffix_windows_of_long_texts(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcd") for _ in range(9000))
    texts = [base, "x" + base[2000:5000] + "y" + base[100:400], base[7000:7150], "ab" * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([base])], ["_k", "_text"])
    parts = list(suffixes.windows(iter([batch]), 60, 1000))
    assert len(parts) == 9 and all(len(t[0]) <= 1059 and base[b[0] :].startswith(t[0].decode()) for t, b, _ in parts)
    out = [(b[0] + i, t[0][i : i + 60]) for t, b, _ in parts for i in range(len(t[0]) - 59)]
    assert out == [(i, base[i : i + 60].encode()) for i in range(len(base) - 59)]
    rows = sorted(suffixes.remove_repeats(make(spark, texts), 60).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == brute_spans(texts, 60)


def hashed_spans(texts, length):
    """As ``brute_spans``, by hashes of the strings."""
    import xxhash

    raw = [t.encode() for t in texts]
    marks = [np.fromiter((xxhash.xxh3_64_intdigest(b[i : i + length]) for i in range(len(b) - length + 1)), np.uint64, count=max(0, len(b) - length + 1)) for b in raw]
    value, times = np.unique(np.concatenate(marks), return_counts=True)
    out = []
    for b, own in zip(raw, marks, strict=True):
        again = np.flatnonzero(times[np.searchsorted(value, own)] > 1)
        edge = np.zeros(len(b) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out.append((len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_shards_of_one_key_are_merged_at_default_bounds(spark):
    """More texts share a passage than a shard takes segments, so that the strings at its ends meet across shards."""
    rnd = random.Random(12)
    passage = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(230))
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(9000)]
    texts = [x[:30] + passage + x[30:] for x in noise]
    rows = suffixes.remove_repeats(make(spark, texts).repartition(6)).collect()
    want = hashed_spans(texts, 200)
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows} == dict(enumerate(want))
    assert min(n for _, n, _ in want) >= 230 and max(n for _, n, _ in want) > 233
