"""Exact removal of repeated byte strings with sharded suffix arrays.

Every string of ``length`` bytes that starts at two or more places (in any texts) has the same anchor at the same
offset in all of them: the leftmost least hash among its 32-byte grams.  Consecutive starts with one anchor form a
segment, so that all equal strings meet under one anchor key.  Keys that occur once hold no repeats and end there.
Equal segments that follow each other in a text (runs of one character, short periods) are one row with their number.

1. Segments whose key recurs are collapsed to distinct segments with their numbers of occurrences; one with two
   or more is repeated whole.
2. Distinct segments of a key with a single-occurrence one are dealt to shards of bounded size.  A shard sorts
   their suffixes by Larsson-Sadakane refinement in numpy and takes Kasai's common prefixes; a string is repeated
   if it shares ``length`` bytes with a neighbour in the suffix array.
3. A key with more distinct segments than a shard takes is dealt over several shards; their sorted strings,
   one row per distinct string and shard, are merged by binary search.

The removed spans are the unions of the repeated strings, judged on the input.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column_of, give_back, id_text, mix64, shared_checkpoint, slices

GRAM = 32
PLACE = np.uint64((1 << 31) - 1)
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling: out[i + done] = out[i] * base ** done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts: text number, anchor hash, first start, last start, anchor place (all in ``raw``)."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=prefix[1:])
    grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * powers(INVERSE, n - GRAM + 1))
    ordered = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(ordered, length - GRAM + 1)
    place = (least & PLACE).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    valid = np.arange(len(place)) + length <= ends[owner]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place, owner = place[starts], owner[starts]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], grams[place[first]].view(np.int64), starts[first], starts[last], place[first]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's place in that order.

    Larsson-Sadakane refinement: groups of suffixes with equal first h bytes are split by the groups of the
    suffixes h bytes on, h doubling each round; groups of one are never touched again.
    """
    n = len(text)
    padded = np.append(text.astype(np.int64) + 1, np.zeros(7, np.int64))  # zero stands for the end
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 257 + padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.append(True, key[1:] != key[:-1])
    group = np.empty(n, np.int64)  # the place of a group's first member stands for the group
    group[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    h = 7
    single = starts & np.append(starts[1:], True)
    places = np.flatnonzero(~single)
    while len(places):
        members = order[places]
        onward = np.where(members + h < n, group[np.minimum(members + h, n - 1)] + 1, 0)
        key = group[members] << 32 | onward
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[places] = members
        new = np.append(True, key[1:] != key[:-1])
        group[members] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        single = new & np.append(new[1:], True)
        places = places[~single]
        h *= 2
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    return order, at


def common_prefixes(text: np.ndarray, order: np.ndarray, at: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix lengths, up to ``most``, of each suffix and the one before it in the suffix array.

    The walk over a segment's suffixes carries the length, less one, from each to the next; all segments
    (``counts`` suffixes from ``starts``) walk in step.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    have = np.zeros(len(starts), np.int64)
    for step in range(int(counts.max(initial=0))):
        go = np.flatnonzero(counts > step)
        i = starts[go] + step
        place = at[i]
        j = np.where(place > 0, order[place - 1], n)
        got = np.maximum(have[go] - 1, 0)
        live = np.flatnonzero(j < n)
        got[j >= n] = 0
        while len(live):
            a, b = i[live] + got[live], j[live] + got[live]
            more = (got[live] < most) & (np.maximum(a, b) < n)
            more &= text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
            live = live[more]
            got[live] += 1
        have[go] = got
        out[place] = got
    return out


def repeated_starts(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the string starts of all segments: segment number, start in it, whether another start has the same
    string, and whether it is the first of its string in the suffix array."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    text = np.frombuffer(b"".join(segments), np.uint8)
    counts, begins = sizes - length + 1, np.cumsum(sizes) - sizes
    order, at = suffix_array(text)
    prefix = common_prefixes(text, order, at, begins, sizes, length)
    number = np.repeat(np.arange(len(segments)), counts)
    start = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = begins[number] + start
    place = at[where]
    # Neighbours that are no whole string of their segment are no start of a string: they are left out first.
    kept = np.sort(place)
    runs = np.minimum.reduceat(np.append(prefix, 0), kept + 1)
    same_as_next = np.append(runs[:-1] >= length, False)
    same_as_last = np.append(False, same_as_next[:-1])
    by = np.argsort(place, kind="stable")
    again, lead = np.zeros(len(where), bool), np.zeros(len(where), bool)
    again[by], lead[by] = same_as_next | same_as_last, ~same_as_last
    return number, start, again, lead


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def windows(batches: Iterator[pa.RecordBatch], length: int, max_bytes: int = 2 << 20) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of about ``max_bytes`` in all with their begins and keys; a longer text comes in windows, each with its own
    string starts, so that the dozen eight-byte arrays over the bytes at hand stay bounded."""
    for b in slices(batches, max_bytes=max_bytes):
        texts = pc.fill_null(column_of(b, "_text").cast(pa.binary()), b"").to_pylist()
        keys = column_of(b, "_k").to_numpy(zero_copy_only=False)
        if len(texts) > 1 or len(texts[0]) <= 2 * max_bytes:
            yield texts, np.zeros(len(texts), np.int64), keys
            continue
        for at in range(0, len(texts[0]) - length + 1, max_bytes):
            yield [texts[0][at : at + max_bytes + length - 1]], np.array([at]), keys


def repeated_spans(docs: DataFrame, length: int = 200, shard_bytes: int = 2 << 20, shard_segments: int = 8192) -> DataFrame:
    """``_k long, _spans array<struct<_from,_to>>`` for texts (``_k``, ``_text``) with repeated strings of ``length`` bytes."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for texts, begin, key_of in windows(batches, length):
            sizes = np.fromiter(map(len, texts), np.int64, count=len(texts))
            whole = b"".join(texts)
            owner, key, first, last, place = anchors(np.frombuffer(whole, np.uint8), sizes, length)
            begins = np.cumsum(sizes) - sizes
            same = np.fromiter((digest(whole[i : j + length], 7) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, count=len(first))
            same = mix64(same + (place - first).astype(np.uint64)).view(np.int64)
            # equal segments one after the other: one row
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (same[1:] != same[:-1]) | (owner[1:] != owner[:-1])))[: len(key)]
            times = np.diff(np.append(head, len(key)))
            end = last[head + times - 1] + length if len(head) else head
            own, at = owner[head], first[head]
            local = at - begins[own] + begin[own]
            columns = [(key[head], pa.int64()), (same[head], pa.int64()), (key_of[own], pa.int64()), (local, pa.int32()), (last[head] - at + length, pa.int32()), (times, pa.int32()), (end - at, pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in columns], names)

    names = ["_h", "_s", "_k", "_a", "_len", "_m", "_run"]
    all_segments = docs.mapInArrow(segments, "_h long, _s long, _k long, _a int, _len int, _m int, _run int")
    # Written first, so that the join below is of two plain shuffles, whose hot keys adaptive execution can split.
    recurring = shared_checkpoint(all_segments.groupBy("_h").agg(F.sum("_m").alias("_c")).filter("_c > 1").select("_h"))
    found = shared_checkpoint(all_segments.join(recurring, "_h"))

    distinct = found.groupBy("_h", "_s").agg(F.sum("_m").alias("_n"), F.min(F.struct("_k", "_a", "_len")).alias("_e"))
    distinct = shared_checkpoint(distinct.select("_h", "_s", "_n", "_e.*"))
    whole = found.join(distinct.filter("_n > 1").select("_h", "_s"), ["_h", "_s"]).select("_k", F.col("_a").alias("_from"), (F.col("_a") + F.col("_run")).alias("_to"))

    keys = distinct.groupBy("_h").agg(F.count("*").alias("_d"), F.sum((F.col("_n") == 1).cast("int")).alias("_u"), F.sum("_len").alias("_b")).filter("_d > 1 AND _u > 0")
    sized = keys.agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("b"), F.coalesce(F.max("_d"), F.lit(0)).alias("d")).first()
    shards = max(1, -(-int(sized["b"]) // shard_bytes))
    parts = F.ceil(F.col("_d") / shard_segments)
    wanted = distinct.join(keys.select("_h", parts.alias("_parts")), "_h")
    wanted = wanted.withColumn("_shard", F.pmod(F.xxhash64("_h", F.pmod(F.xxhash64("_s"), F.col("_parts"))), F.lit(shards)))
    lists = wanted.groupBy("_k").agg(F.collect_list(F.struct("_h", "_s", "_n", "_a", "_len", "_shard", (F.col("_parts") > 1).alias("_hot"))).alias("_w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_shard", "_h", "_s", "_n", "_k", "_a", "_hot", "_seg"]
        types = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.binary()]
        for b in slices(batches, max_bytes=4 << 20):
            rows = []
            for k, text, wants in zip(column_of(b, "_k").to_pylist(), column_of(b, "_text").cast(pa.binary()).to_pylist(), column_of(b, "_w").to_pylist(), strict=True):
                rows += [(w["_shard"], w["_h"], w["_s"], w["_n"], k, w["_a"], w["_hot"], text[w["_a"] : w["_a"] + w["_len"]]) for w in wants]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    pieces = docs.join(lists, "_k").mapInArrow(cut, "_shard long, _h long, _s long, _n long, _k long, _a int, _hot boolean, _seg binary")

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # repeated rows have brought their segments several times
        first = np.unique(np.rec.fromarrays([table.column("_h").to_numpy(), table.column("_s").to_numpy()]), return_index=True)[1]
        table = table.take(pa.array(first))
        n, k, a = (table.column(c).to_numpy() for c in ("_n", "_k", "_a"))
        hot = table.column("_hot").to_numpy(zero_copy_only=False)
        segs, h = table.column("_seg").to_pylist(), table.column("_h").to_pylist()
        number, start, again, lead = repeated_starts(segs, length)
        give_back()
        again |= n[number] > 1
        out: dict[str, list] = {c: [] for c in ("_k", "_from", "_to", "_mark", "_again")}
        cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)) if len(number) else np.zeros(1, int)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s = int(number[i])
            if n[s] == 1:
                for lo, hi in _runs(again[i:j]):
                    for c, v in zip(out, (int(k[s]), int(a[s]) + lo, int(a[s]) + hi + length, None, True), strict=True):
                        out[c].append(v)
            if hot[s]:  # its strings may recur in the key's other shards
                for t in np.flatnonzero(~again[i:j] | lead[i:j]).tolist():
                    mark = hashlib.blake2b(segs[s][t : t + length], digest_size=16, salt=(h[s] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")).digest()
                    for c, v in zip(out, (int(k[s]), int(a[s]) + t, int(a[s]) + t + length, mark, bool(again[i + t])), strict=True):
                        out[c].append(v)
        return pa.table({"_k": pa.array(out["_k"], pa.int64()), "_from": pa.array(out["_from"], pa.int32()), "_to": pa.array(out["_to"], pa.int32()), "_mark": pa.array(out["_mark"], pa.binary()), "_again": pa.array(out["_again"], pa.bool_())})

    solved = pieces.groupBy("_shard").applyInArrow(solve, "_k long, _from int, _to int, _mark binary, _again boolean")
    if sized["d"] > shard_segments:
        solved = shared_checkpoint(solved)
        marked = solved.filter("_mark IS NOT NULL").repartition("_mark")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            if not table.num_rows:
                return
            marks = table.column("_mark").to_pylist()
            halves = np.frombuffer(b"".join(m[:8] for m in marks), "<u8")
            ordered = np.sort(halves)
            # strings of other shards with the same mark: binary search for its first and last place
            near = np.searchsorted(ordered, halves, "right") - np.searchsorted(ordered, halves, "left") > 1
            full = Counter(marks[i] for i in np.flatnonzero(near).tolist())
            twice = np.fromiter((full[m] > 1 for m in marks), bool, count=len(marks))
            yield from table.filter(pa.array(twice & ~table.column("_again").to_numpy(zero_copy_only=False))).select(["_k", "_from", "_to"]).to_batches()

        crossed = marked.mapInArrow(merge, "_k long, _from int, _to int")
        spans = solved.filter("_mark IS NULL").select("_k", "_from", "_to").unionByName(crossed)
    else:
        spans = solved.filter("_mark IS NULL").select("_k", "_from", "_to")
    return whole.unionByName(spans).groupBy("_k").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False, **bounds: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` and the carried columns: a row for each row of ``docs``.

    ``kept`` is binary, as a span may end within a character; with ``as_text`` it is a string without the pieces of
    such characters.

    A null or empty text has no bytes; texts shorter than ``length`` stay whole.  Repeated rows are texts of their
    own, so that their long strings all go.  A null id stays null.  ``bounds`` are those of ``repeated_spans``.
    """
    own = id_text(docs, id_col, text_col, carry).withColumn("_k", F.xxhash64("_id", "_text"))
    spans = repeated_spans(own.select("_k", "_text"), length, **bounds).withColumnRenamed("_k", "_key")

    more = [f"_c{i}" for i in range(len(carry))]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=2 << 20):
            out: list[tuple] = []
            for text, cut in zip(pc.fill_null(column_of(b, "_text").cast(pa.binary()), b"").to_pylist(), column_of(b, "_spans").to_pylist(), strict=True):
                kept, at, runs = [], 0, 0  # at: end of the run that is being removed
                for x in sorted((c["_from"], c["_to"]) for c in cut or ()):
                    if not runs or x[0] > at:
                        kept.append(text[at : x[0]])
                        runs += 1
                    at = max(at, x[1])
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), runs, rest.decode("utf-8", "ignore") if as_text else rest))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types)), *(column_of(b, c) for c in more)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    joined = own.join(spans, F.col("_k") == F.col("_key"), "left").select("_id", "_text", "_spans", *more)
    return joined.mapInArrow(edit, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}" + carried(docs, carry))


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The contract query in SQL: all 200-byte strings by their digests, and the runs of those that come again.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM docs),
starts AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 199, 0))) AS i FROM sized)),
again AS (SELECT doc_id, i FROM starts SEMI JOIN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1) USING (s)),
edges AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS k FROM sized JOIN gaps USING (doc_id) GROUP BY 1),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM sized LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
