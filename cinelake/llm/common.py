"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files of the public tokenizers are looked up by name.
def vocab_path(name: str) -> str:
    """Local path of a public vocabulary file on whichever machine calls this."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the id (as long), the text and the columns to carry along, under private names that clash with nothing."""
    own = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")]
    return docs.select(*own, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])


def carried(docs: DataFrame, carry: tuple[str, ...]) -> str:
    """The carried columns as the tail of a schema string."""
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``.  Only in local mode, where all workers share this machine's
    disk, a temporary one stands in for a missing setting; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], text: str = "_text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text (a longer single text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        offsets = np.concatenate([[0], np.cumsum(text_sizes(column))])
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later stages, and the executor pays for them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> list[str]:
    """The texts as Python strings, null as the empty string."""
    return [t if t is not None else "" for t in column_of(batch, name).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-xorshift hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space, as (number of each word, distinct words, words per text)."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), counts


def word_hashes(words: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
