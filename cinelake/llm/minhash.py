"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find grouping.

1. Each text's set of hashed word shingles gives a digest and a SuperMinHash signature.  Every element draws
   its slots in the order of a random permutation of its own, with values that grow by one a level, so a text is
   finished at the first level at which all its slots are filled.
2. Texts of equal sets form classes, which are numbered.
3. Bands of the signature give buckets.  All members of a bucket are verified against its least member on the full
   sets; a large bucket is spread over tasks, each of which streams members past the leader's set.  Union-find over
   these links joins most copies for good.
4. What may still be linked are members of one bucket, other than its leader, in different components.  They are
   compared in blocks of bounded size, by an intersection-count matrix.  A large component has blocks of its own, which
   are not compared with each other: within it there is nothing to find.  No pairs are emitted but the links found.
5. Union-find over all links gives the components; classes carry them to all their documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, id_text, mix64, shared_checkpoint, slices, word_hashes, words_of
from .graph import components, links_within

ROWS, MISSED = 6, 1e-6


def band_count(percent: int, rows: int = ROWS, missed: float = MISSED) -> int:
    """Bands with which a pair at the threshold shares no bucket with a probability of at most ``missed``."""
    return math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** rows))


LEVEL = np.uint64(1 << 32)
#: Stands for the blocks that small components share; components are numbered from zero.
SHARED = -1
LOOKBACK = 12


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text; fewer words than ``width`` are one shingle, none are none."""
    index, words, counts = words_of(column)
    hashes = word_hashes(words)[index]
    ends = np.cumsum(counts)
    n = len(hashes)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(whole[end - count : end - width + 1]))
        elif count:
            short = np.array([count], np.uint64)
            for x in hashes[end - count : end]:
                short = mix64(short * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (texts x slots) of nonempty sets, all sets level by level."""
    sizes = np.array([len(s) for s in sets])
    h = np.full(len(sets) * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    seed = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    froms: list[np.ndarray] = []  # per level: the index that an element has drawn, and what moved there
    moved: list[np.ndarray] = []
    perm = None
    for level in range(slots):
        random = mix64(seed + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        drawn = (np.uint64(level) + ((random & (LEVEL - np.uint64(1))) * np.uint64(slots - level) >> np.uint64(32))).astype(np.int16)
        if perm is None:
            slot, own = drawn.copy(), np.full(len(seed), level, np.int16)
            for f, v in zip(froms, moved, strict=True):
                np.copyto(slot, v, where=f == drawn)
                np.copyto(own, v, where=f == level)
            froms.append(drawn)
            moved.append(own)
        else:
            rows = np.arange(len(seed))
            slot = perm[rows, drawn]
            perm[rows, drawn] = perm[:, level]
        np.minimum.at(h, owner * slots + slot, np.uint64(level) * LEVEL + (random >> np.uint64(32)))
        done = h.reshape(-1, slots).max(axis=1) < np.uint64(level + 1) * LEVEL
        if done.all():
            break
        if level < 4 or level % 4 == 0 or level == LOOKBACK:
            keep = ~done[owner]
            if not keep.all():
                seed, owner = seed[keep], owner[keep]
                froms, moved = [f[keep] for f in froms], [v[keep] for v in moved]
                perm = perm[keep] if perm is not None else None
        if level == LOOKBACK:  # few elements are left: whole permutations from here on
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(seed), 1))
            rows = np.arange(len(seed))
            for f, v in zip(froms, moved, strict=True):
                perm[rows, f] = v
            froms, moved = [], []
    return h.reshape(-1, slots)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``_id, _key, _n, _digest, _bands`` of each row (``_id, _key, _text``); an empty set has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=4 << 20):
            sets = shingle_sets(column_of(b, "_text"), width)
            full = [s for s in sets if len(s)]
            hashes = band_hashes(super_minhash(full, bands * rows), bands, rows) if full else np.zeros((0, bands), np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            offsets = np.append(0, np.cumsum(np.where(sizes > 0, bands, 0))).astype(np.int32)
            digests = [digest_of(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [column_of(b, "_id"), column_of(b, "_key"), pa.array(sizes), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel()))],
                ["_id", "_key", "_n", "_digest", "_bands"],
            )

    return docs.mapInArrow(run, "_id long, _key long, _n long, _digest binary, _bands array<long>")


def intersections(sets: list[np.ndarray], dense_from: int = 9, columns: int = 2048) -> np.ndarray:
    """Counts of common elements of all pairs of sets.  Rare elements are paired directly, frequent ones by a matrix product."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    counts = np.diff(np.append(starts, len(flat)))
    out = np.zeros(n * n, dtype=np.int64)
    rare = np.repeat(counts < dense_from, counts)
    value, who = flat[rare], owner[rare]
    for lag in range(1, dense_from - 1):
        same = np.flatnonzero(value[lag:] == value[:-lag])
        if not len(same):
            break
        out += np.bincount(who[same] * n + who[same + lag], minlength=n * n)
    out = out.reshape(n, n).astype(np.float32)
    out += out.T.copy()
    heavy = np.flatnonzero(counts >= dense_from)
    for i in range(0, len(heavy), columns):
        some = heavy[i : i + columns]
        x = np.zeros((n, len(some)), dtype=np.float32)
        at = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[some].tolist(), counts[some].tolist(), strict=True)])
        x[owner[at], np.repeat(np.arange(len(some)), counts[some])] = 1
        out += x @ x.T
    return out


def text_sets(texts: DataFrame, width: int) -> DataFrame:
    """``_v, _set``: the sorted shingles of rows ``_v, _digest, _text`` whose set has this digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=4 << 20):
            packed = [s.tobytes() for s in shingle_sets(column_of(b, "_text"), width)]
            own = pa.array([digest_of(s) == d for s, d in zip(packed, column_of(b, "_digest").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([column_of(b, "_v"), pa.array(packed, pa.binary())], ["_v", "_set"]).filter(own)

    return texts.select("_v", "_digest", "_text").mapInArrow(run, "_v long, _set binary")


def digest_of(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def leader_links(pairs: DataFrame, sets: DataFrame, percent: int, part: int = 4096) -> DataFrame:
    """Of the pairs ``_a, _b`` (member and leader) those whose sets are alike enough.

    A leader with many members is sent to as many tasks as ``part`` members each need; a task holds one leader's set.
    """
    counted = pairs.groupBy("_b").agg(F.ceil(F.count("*") / part).cast("int").alias("_k"))
    members = pairs.join(counted, "_b").select("_b", F.expr("pmod(xxhash64(_a), _k)").cast("int").alias("_p"), F.col("_a").alias("_v"), F.lit(1).alias("_m"))
    leaders = counted.select("_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_p"), F.col("_b").alias("_v"), F.lit(0).alias("_m"))
    rows = members.unionByName(leaders).join(sets, "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, lead = None, np.zeros(0, np.uint64)
        for b in batches:
            a, c = [], []
            for v, of, m, packed in zip(*(column_of(b, n).to_pylist() for n in ("_v", "_b", "_m", "_set")), strict=True):
                own = np.frombuffer(packed, np.uint64)
                if not m:
                    leader, lead = of, own
                    continue
                if leader != of:
                    raise ValueError("a leader's set is missing")
                few, many = sorted((len(own), len(lead)))
                if 100 * few < percent * many:
                    continue
                at = np.searchsorted(lead, own)
                common = int((lead[np.minimum(at, len(lead) - 1)] == own).sum())
                if 100 * common >= percent * (few + many - common):
                    a.append(v)
                    c.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["_a", "_b"])

    return rows.repartition("_b", "_p").sortWithinPartitions("_b", "_p", "_m").mapInArrow(run, "_a long, _b long")


def block_links(members: DataFrame, sets: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """Links between members (``_v, _g, _c, _n``) of a group ``_g`` that are in different components ``_c``.

    A component that fills half a block has blocks of its own; the others of a group share blocks.  Every block meets
    every other one, and shared blocks themselves, but for two blocks of one component.
    """
    over = lambda m, t: F.greatest(F.ceil(F.col(m) / block), F.ceil(F.col(t) / block_shingles)).cast("int")
    counted = members.groupBy("_g", "_c").agg(F.count("*").alias("_m"), F.sum("_n").alias("_t"))
    own = (2 * F.col("_m") >= block) | (2 * F.col("_t") >= block_shingles)
    counted = counted.select("_g", "_c", F.when(own, F.col("_c")).otherwise(SHARED).alias("_o"), "_m", "_t")
    kinds = counted.groupBy("_g", "_o").agg(F.sum("_m").alias("_m"), F.sum("_t").alias("_t")).select("_g", "_o", over("_m", "_t").alias("_k"))
    named = F.transform(F.collect_list(F.struct("_o", "_k")), lambda x: F.transform(F.sequence(F.lit(0), x["_k"] - 1), lambda i: F.struct(x["_o"].alias("o"), i.alias("i"))))
    blocks = kinds.groupBy("_g").agg(F.flatten(named).alias("_blocks"))
    sized = counted.join(kinds.select("_g", "_o", "_k"), ["_g", "_o"]).select("_g", "_c", "_o", "_k")
    placed = members.join(sized, ["_g", "_c"]).withColumn("_at", F.struct(F.col("_o").alias("o"), F.expr("cast(pmod(xxhash64(_v), _k) as int)").alias("i")))
    met = placed.join(blocks, "_g").select("_v", "_g", "_at", F.explode(F.filter("_blocks", lambda x: (F.col("_o") == SHARED) | (x["o"] != F.col("_o")))).alias("_with"))
    paired = met.select("_v", "_g", F.least("_at", "_with").alias("_p"), F.greatest("_at", "_with").alias("_q")).join(sets, "_v")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, found = pdf["_v"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["_set"]]
        common = intersections(found)
        size = np.array([len(s) for s in found], dtype=np.float32)
        both = np.argwhere(np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1))
        a, b = links_within(both, ids)
        return pd.DataFrame({"_a": pd.Series(a, dtype="int64"), "_b": pd.Series(b, dtype="int64")})

    return paired.groupBy("_g", "_p", "_q").applyInPandas(verify, "_a long, _b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None, rows: int = ROWS, block: int = 1024, block_shingles: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row for each row of ``docs``; with ``with_key`` also ``text_key``,
    Spark's 64-bit hash of the text, by which rows of one id are told apart.

    Documents are linked if 100 * common >= ``percent`` * union over their distinct word shingles.  Null or empty
    texts have no shingles and are linked with nothing.  Rows that repeat an id with equal texts share a class; with
    unequal texts each has its own text's component.  A row with a null id has a null component and is kept.
    """
    bands = bands or band_count(percent, rows)
    own = id_text(docs, id_col, text_col).withColumn("_key", F.xxhash64("_text"))
    sized = shared_checkpoint(signed(own, width, bands, rows))
    full = sized.filter("_n > 0 AND _id IS NOT NULL")
    classes = full.groupBy("_digest").agg(F.min("_id").alias("_rep"), F.min_by(F.struct("_n", "_bands"), "_id").alias("_f"))
    classes = shared_checkpoint(classes.select("_digest", "_rep", "_f.*", F.monotonically_increasing_id().alias("_v")))
    keyed = classes.select(F.col("_v").alias("_a"), F.explode("_bands").alias("_key"))
    buckets = keyed.groupBy("_key").agg(F.min("_a").alias("_b"), F.max("_a").alias("_z")).filter("_b < _z").select("_key", "_b")
    met = shared_checkpoint(keyed.join(buckets, "_key").filter("_a <> _b"))
    pairs = met.select("_a", "_b").distinct()
    some = pairs.select(F.explode(F.array("_a", "_b")).alias("_v")).distinct().join(classes.select("_v", "_rep", "_digest"), "_v")
    texts = own.join(some, F.col("_id") == F.col("_rep"))
    sets = shared_checkpoint(text_sets(texts, width).dropDuplicates(["_v"]))
    # links are written before they are contracted, so that no task runs two Python workers
    first = components(shared_checkpoint(leader_links(pairs, sets, percent)))

    # members of a bucket besides its leader that are in different components
    rest = met.join(first.withColumnRenamed("_v", "_a"), "_a", "left").select("_key", "_a", F.coalesce("_c", "_a").alias("_c"))
    unlike = rest.groupBy("_key").agg(F.min("_c").alias("_x"), F.max("_c").alias("_y"), F.min("_a").alias("_b")).filter("_x < _y").select("_key", "_b")
    rest = shared_checkpoint(rest.join(unlike, "_key").select("_a", "_b", "_c").distinct())
    groups = components(rest.select("_a", "_b")).withColumnRenamed("_c", "_g")
    members = rest.select(F.col("_a").alias("_v"), "_c").distinct().join(groups, "_v").join(classes.select("_v", "_n"), "_v")
    second = shared_checkpoint(block_links(members, sets, percent, block, block_shingles))
    found = components(first.select(F.col("_v").alias("_a"), F.col("_c").alias("_b")).unionByName(second))

    # Classes carry the least document of their component to all their rows.
    linked = found.join(classes.select("_v", "_rep", "_digest"), "_v")
    least = linked.groupBy("_c").agg(F.min("_rep").alias("_least"))
    reached = linked.join(least, "_c").select("_digest", "_least")
    reached = classes.select("_digest", "_rep").join(reached, "_digest", "left").select("_digest", F.coalesce("_least", "_rep").alias("_least"))
    labelled = sized.select("_id", "_key", "_n", "_digest").join(reached, "_digest", "left").select("_id", "_key", "_n", F.when(F.col("_n") > 0, F.coalesce("_least", "_id")).otherwise(F.col("_id")).alias("_c"))
    return labelled.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.col("_c")).alias("component_id"), (F.col("_id").isNull() | (F.col("_id") == F.col("_c"))).alias("kept"), *([F.col("_key").alias("text_key")] if with_key else []))


#: The contract query in SQL: sets by their shingles as text, all pairs that share one, and reachability.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
classes AS (SELECT s, len(s) AS n, min(doc_id) AS v FROM sets WHERE len(s) > 0 GROUP BY s),
rows AS (SELECT v, n, unnest(s) AS x FROM classes),
common AS (SELECT a.v AS a, b.v AS b, a.n AS na, b.n AS nb, count(*) AS c FROM rows a JOIN rows b ON a.x = b.x AND a.v < b.v AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT v, v AS r FROM classes UNION SELECT r.v, l.b FROM reach r JOIN both_ways l ON l.a = r.r),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least USING (v)
"""
