"""Ordered folds: one pass over the sorted rows of each key, with the state carried from batch to batch.

What depends on its own earlier output (filters with feedback, greedy spacing, segments) has no window form.  Rows are
dealt by key and sorted within partitions; Arrow batches stream through, so that a task holds a batch and a state,
never a whole stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold(Protocol):
    def step(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Output for the next rows of the key, in order (possibly none yet)."""

    def finish(self) -> pa.RecordBatch | None:
        """Output after the key's last row."""


def changes(batch: pa.RecordBatch, key: list[str]) -> list[int]:
    """Where the key changes, with both ends of the batch."""
    new = np.zeros(batch.num_rows, bool)
    for k in key:
        column = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt so that those of a key meet in one task, by a hash of it.

    Dealing by the columns themselves is left out of the plan where the rows already lie so, and what adaptive execution
    then joins up or splits (unions whose sides are dealt alike, skewed joins) may leave a key in several tasks.
    """
    return rows.repartition(F.xxhash64(*key))


def ordered_fold(rows: DataFrame, key: list[str], at: list[str], start: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """The outputs of a fold (``start`` makes it from the key's values) over the rows of each key in the order of ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for b in batches:
            edges, out = changes(b, key), []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(i, j - i)
                own = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in key)
                if fold is None or own != now:
                    out.append(fold.finish() if fold is not None else None)
                    now, fold = own, start(own)
                out.append(fold.step(part))
            made = [x for x in out if x is not None and x.num_rows]
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        last = fold.finish() if fold is not None else None
        if last is not None and last.num_rows:
            yield last

    return dealt(rows, *key).sortWithinPartitions(*key, *at).mapInArrow(run, schema)
