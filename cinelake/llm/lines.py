"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

Line keys are dealt to shards by their digest.  A shard holds an exact table (key -> reference count, least
and most document that hold the line) behind a cuckoo filter.  A key that the
filter does not know is certainly new and skips the table's lookup; a key that it may know is settled by the
table.  Counts only change by documents added or deleted, and the filter supports deletion, so that an index
follows a corpus in both directions (:class:`LineIndex`).

For a whole corpus the documents' references are first combined by key within each input partition, so that a
line that a third of all documents share reaches its shard as one row per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, column_of, id_text, slices, texts_of

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: About as many keys as a shard's exact table and filter hold in memory.
SHARD_KEYS = 500_000


class CuckooFilter:
    """Partial-key cuckoo filter on arrays: four 16-bit fingerprints a bucket, insertions, lookups and deletions.

    Keys are 64-bit digests.  It grows by rebuilding from the exact keys of the shard's table, so that no
    insertion fails and no key is lost.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.8)))))
        self.table = np.zeros((self.buckets, self.SLOTS), dtype=np.uint16)
        self.size = 0

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return marks, one, self._other(one, marks)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return (bucket ^ (marks.astype(np.int64) * 0x5BD1E995)) & (self.buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, one, two = self._place(keys)
        return (self.table[one] == marks[:, None]).any(1) | (self.table[two] == marks[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert distinct keys.  False if the filter is too full: rebuild it larger from the exact table."""
        if (self.size + len(keys)) > self.buckets * self.SLOTS * 0.9:
            return False
        marks, one, two = self._place(keys)
        rest = np.arange(len(keys))
        for bucket in (one, two):  # all keys at once, each bucket takes one key a pass
            for _ in range(self.SLOTS):
                if not len(rest):
                    break
                at = bucket[rest]
                slot = (self.table[at] == 0).argmax(1)
                free = self.table[at, slot] == 0
                _, first = np.unique(at, return_index=True)
                lead = np.zeros(len(rest), bool)
                lead[first] = True
                put = free & lead
                self.table[at[put], slot[put]] = marks[rest[put]]
                rest = rest[~put]
        rng = np.random.default_rng(self.buckets)
        for i in rest.tolist():
            if not self._kick(int(marks[i]), int(two[i]), rng):
                return False
        self.size += len(keys)
        return True

    def _kick(self, mark: int, bucket: int, rng: np.random.Generator) -> bool:
        for _ in range(self.KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            slot = int(rng.integers(self.SLOTS))
            mark, row[slot] = int(row[slot]), mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], dtype=np.uint16))[0])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Delete keys that are in the filter (the exact table says which)."""
        marks, one, two = self._place(keys)
        for mark, buckets in zip(marks, zip(one.tolist(), two.tolist(), strict=True), strict=True):
            for bucket in buckets:
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    self.size -= 1
                    break


class Shard:
    """The exact reference-count table of one shard behind its cuckoo filter: key -> (references, least, most).

    References are counted per row; two or more distinct documents hold a key if its least and most differ.
    """

    def __init__(self) -> None:
        self.table: dict[bytes, tuple[int, int, int]] = {}
        self.filter = CuckooFilter()
        self.skipped = 0  # lookups that the filter has saved

    def insert(self, digests: list[bytes], counts: list[int], least: list[int], most: list[int]) -> None:
        """Add references.  A key may come several times."""
        marks = _marks(digests)
        known = self.filter.contains(marks).tolist()
        table, fresh, where = self.table, {}, []
        for i, d in enumerate(digests):
            held = fresh.get(d) or (table.get(d) if known[i] else None)
            if held is None:
                fresh[d] = (counts[i], least[i], most[i])
                where.append(i)
            else:
                (fresh if d in fresh else table)[d] = (held[0] + counts[i], min(held[1], least[i]), max(held[2], most[i]))
        self.skipped += len(digests) - sum(known)
        table |= fresh
        if where and not self.filter.insert(marks[where]):
            self._rebuild()

    def delete(self, digests: list[bytes], counts: list[int]) -> list[bytes]:
        """Take references away.  Keys without any leave table and filter; returns the keys that stay.

        Their least and most holders have to be taken anew from the references that are left.
        """
        known = self.filter.contains(_marks(digests)).tolist() if digests else []
        stay = []
        for d, n, k in zip(digests, counts, known, strict=True):
            held = self.table.get(d) if k else None
            if held is None:
                continue
            if held[0] > n:
                self.table[d] = (held[0] - n, *held[1:])
                stay.append(d)
            else:
                del self.table[d]
                self.filter.delete(_marks([d]))
        return stay

    def shared(self) -> dict[bytes, tuple[int, int, int]]:
        """What two or more distinct documents hold."""
        return {k: v for k, v in self.table.items() if v[1] < v[2]}

    def _rebuild(self) -> None:
        size, marks = len(self.table), _marks(list(self.table))
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            if self.filter.insert(marks):
                return


def _marks(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([d[:8] for d in digests]), dtype="<u8")


def line_key(line: bytes) -> bytes | None:
    """Digest of a line's key, or None for a key of fewer than ten code points."""
    line = line.strip(WHITE).lower()  # bytes: white space is \\x20 and \\x09-\\x0D, and only A-Z change
    if len(line) < MIN_CHARS or (not line.isascii() and len(line.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def references(docs: DataFrame) -> DataFrame:
    """The distinct line keys of each document: ``_key binary, _doc long``.  Null ids hold no references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys: list[bytes] = []
            owners: list[int] = []
            for doc, own in _keys_of(b):
                keys += own
                owners += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["_key", "_doc"])

    return docs.mapInArrow(run, "_key binary, _doc long")


def _keys_of(batch: pa.RecordBatch) -> Iterator[tuple[int, set[bytes]]]:
    for doc, text in zip(column_of(batch, "_id").to_pylist(), texts_of(batch), strict=True):
        if doc is not None:
            yield doc, {k for x in text.encode("utf-8", "replace").split(b"\n") if (k := line_key(x)) is not None}


COUNTS = "_key binary, _refs long, _least long, _most long"


def _count_batches(table: dict[bytes, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    names = ["_key", "_refs", "_least", "_most"]
    rows = list(table.items())
    for i in range(0, len(rows), 50_000):
        some = rows[i : i + 50_000]
        columns = [pa.array([k for k, _ in some], pa.binary())] + [pa.array([v[j] for _, v in some], pa.int64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names)


def reference_counts(docs: DataFrame, least_holders: int = 1, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The exact reference-count table of all line keys, built in shards behind cuckoo filters.

    Each input partition first combines its own references, so that a line that a third of all documents share
    reaches its shard as a row per partition.  A partition's keys come in the order of their first byte, so that it is
    worked off in shards of about ``shard_keys`` keys, whatever its size.  With ``least_holders=2`` only keys that at
    least two distinct documents hold are returned.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple[int, int, int]] = {}
        for b in slices(batches):
            for doc, own in _keys_of(b):
                for k in own:
                    held = table.get(k)
                    table[k] = (1, doc, doc) if held is None else (held[0] + 1, min(held[1], doc), max(held[2], doc))
            if len(table) > 400_000:  # bounded memory: what is combined so far goes on
                yield from _count_batches(table)
                table = {}
        yield from _count_batches(table)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = Shard(), None
        for b in batches:
            first = column_of(b, "_first").to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first)).tolist() if len(first) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if first[i] != at and len(held.table) >= shard_keys:  # no key of a later byte is in this shard
                    yield from _count_batches(held.shared() if least_holders > 1 else held.table)
                    held = Shard()
                at = first[i]
                part = b.slice(i, j - i)
                held.insert(*(column_of(part, n).to_pylist() for n in ("_key", "_refs", "_least", "_most")))
        yield from _count_batches(held.shared() if least_holders > 1 else held.table)

    combined = docs.mapInArrow(combine, COUNTS).withColumn("_first", F.conv(F.hex(F.substring("_key", 1, 1)), 16, 10).cast("int"))
    return combined.repartition("_key").sortWithinPartitions("_first").mapInArrow(shard, COUNTS)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop repeated lines: ``doc_id, n_lines, n_dropped, kept`` and the carried columns for each row.

    A key of at least ten code points that two or more documents hold loses all its lines except in the least
    document that holds it.  Null or empty text: one empty line, kept as the empty text.  Rows that share an id
    are one document, each edited alike.  Rows with a null id hold no references and stay as they are.
    """
    own = id_text(docs, id_col, text_col, carry)
    more = [f"_c{i}" for i in range(len(carry))]
    shared = reference_counts(own, 2).select("_key", "_least")
    # A hot key's references are many rows of one join key, which adaptive execution splits.
    drops = references(own).join(shared, "_key").filter("_doc <> _least").groupBy("_doc").agg(F.collect_set("_key").alias("_drop"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, lines, dropped = [], [], []
            for text, drop in zip(texts_of(b), column_of(b, "_drop").to_pylist(), strict=True):
                split = text.encode("utf-8", "replace").split(b"\n")
                stay = split
                if drop:
                    drop = set(drop)
                    stay = [x for x in split if line_key(x) not in drop]
                kept.append(b"\n".join(stay).decode())
                lines.append(len(split))
                dropped.append(len(split) - len(stay))
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), *(column_of(b, c) for c in more)], ["doc_id", "n_lines", "n_dropped", "kept", *carry])

    return own.join(drops, F.col("_id") == F.col("_doc"), "left").select("_id", "_text", "_drop", *more).mapInArrow(edit, "doc_id long, n_lines long, n_dropped long, kept string" + carried(docs, carry))


class LineIndex:
    """An incremental line index in a shared folder: add documents, delete them again, ask for repeated lines.

    Version ``v`` holds ``v<N>/refs`` (key, document) and ``v<N>/counts`` (the exact table).  An update deals both to
    as many shards as ``shard_keys`` keys each need, reads a shard's counts, rebuilds its filter from them and applies
    the changes.  Versions are written whole, counts last; opening a folder takes its last whole version, so that a
    failed update or a new driver leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.shard_keys = spark, path, shard_keys
        self.version = max(self._whole_versions(), default=-1)

    def _whole_versions(self) -> list[int]:
        """Versions whose counts were committed."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [f.getPath().getName() for f in files.listStatus(root)]
        known = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return [n for n in known if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}/counts/_SUCCESS"))]

    def _read(self, what: str) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], "_key binary, _doc long" if what == "refs" else COUNTS)
        return self.spark.read.parquet(f"{self.path}/v{self.version}/{what}")

    def counts(self) -> DataFrame:
        return self._read("counts")

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents and delete those whose ids are in ``removed``; adding what is there changes nothing."""
        old = self._read("refs")
        gone = old.limit(0) if removed is None else old.join(removed.select(F.col(id_col).cast("long").alias("_doc")).distinct(), "_doc", "left_semi").select("_key", "_doc")
        new = old.limit(0) if added is None else references(id_text(added, id_col, text_col)).distinct().join(old, ["_key", "_doc"], "left_anti")
        refs = old.join(gone, ["_key", "_doc"], "left_anti").unionByName(new)
        to = f"{self.path}/v{self.version + 1}"
        refs.write.mode("overwrite").parquet(f"{to}/refs")
        change = new.withColumn("_n", F.lit(1)).unionByName(gone.withColumn("_n", F.lit(-1)))
        change = change.groupBy("_key").agg(F.sum(F.greatest("_n", F.lit(0))).alias("_add"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("_del"))
        shards = -(-(self._read("counts").count() + change.count()) // self.shard_keys) or 1
        dealt = lambda df: df.withColumn("_shard", F.expr(f"pmod(xxhash64(_key), {shards})"))

        def apply(held: pa.Table, changes: pa.Table) -> pa.Table:
            s = Shard()
            if held.num_rows:
                s.insert(*(held.column(n).to_pylist() for n in ("_key", "_refs", "_least", "_most")))
            keys, add, gone = (changes.column(n).to_pylist() for n in ("_key", "_add", "_del"))
            less = [i for i, n in enumerate(gone) if n]
            s.delete([keys[i] for i in less], [gone[i] for i in less])
            more = [i for i, n in enumerate(add) if n]
            if more:
                s.insert([keys[i] for i in more], [add[i] for i in more], [0] * len(more), [0] * len(more))
            rows = list(s.table.items())
            return pa.table({"_key": pa.array([k for k, _ in rows], pa.binary()), "_refs": pa.array([v[0] for _, v in rows], pa.int64())})

        counted = dealt(self._read("counts")).groupBy("_shard").cogroup(dealt(change).groupBy("_shard")).applyInArrow(apply, "_key binary, _refs long")
        ends = self.spark.read.parquet(f"{to}/refs").groupBy("_key").agg(F.min("_doc").alias("_least"), F.max("_doc").alias("_most"))
        counted.join(ends, "_key").select("_key", "_refs", "_least", "_most").write.mode("overwrite").parquet(f"{to}/counts")
        self.version += 1


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The whole operator in SQL.  Keys are compared as they are.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT k, min(doc_id) AS least FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (least IS NOT NULL AND least <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (least IS NULL OR least = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k) GROUP BY doc_id
"""
