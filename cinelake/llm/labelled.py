"""Bounded samples of labelled rows for training classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on; the documented bound of what reaches the driver.
TRAIN_ROWS = 8000


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves no remainder by five; such rows never train.  A null id is not held out."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids], dtype=bool)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _y, _text`` (whole texts, 0/1 labels) of at most ``rows`` training rows, chosen by a hash of the id.

    Rows with null ids, labels or texts, or with labels other than 0 and 1, do not train; a repeated id trains once,
    by its least text.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).dropna().filter("_y IN (0, 1)")
    chosen = ids.filter("crc32(cast(cast(_id AS string) AS binary)) % 5 <> 0").groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).dropna()
    return own.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_text").alias("_text"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of ``training_sample`` in the order of ids."""
    table = training_sample(docs, labels, label, rows, id_col, text_col).toPandas().sort_values("_id")  # bounded by rows
    return table["_text"].tolist(), table["_y"].to_numpy(dtype=np.int64)


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, ``counts`` long each (0 for empty runs)."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def batches_of(texts: list[str], size: int = 500, chars: int = 4 << 20) -> Iterator[pa.Array]:
    """Arrays of at most ``size`` texts and about ``chars`` characters (a longer single text stands alone)."""
    some: list[str] = []
    held = 0
    for text in texts:
        if some and (len(some) == size or held + len(text) > chars):
            yield pa.array(some, pa.string())
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield pa.array(some, pa.string())
