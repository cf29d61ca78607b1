"""Order-preserving packing by dynamic programming over window cuts.

The tokens of a task's documents are one stream, in the order of the rows.  A window is a stretch of it of at most
``capacity`` tokens.  Windows may end at documents' and sentences' ends, and, in stretches without either, every
``stride`` tokens.  The program minimises the padding of all windows plus a penalty for each cut: none at a document's
end, ``sentence_penalty`` at a sentence's, ``inner_penalty`` within a sentence; at equal cost it takes fewer windows.

With ``f`` the least cost up to a position, a window from i to j costs ``f(i) + capacity - (j - i)``: the least
``f(i) + i`` of the last ``capacity`` positions heads a monotone queue, so that each position enters and leaves once.
Windows whose length is a power of two are not padded; their few possible beginnings are looked up beside the queue.

Rows are not shuffled.  A slice of a task's text is a program of its own, so that memory is bounded by the slice and the longest
document, and a lost executor only repeats its own partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Codec, codec
from .common import column_of, id_text, slices

#: One token of cost outweighs any number of windows.
TOKEN = 1 << 30


def padding(fill: int, capacity: int) -> int:
    """Tokens that are added to a window of ``fill`` tokens: none at a power of two."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def best_cuts(at: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """Positions of the least costly cuts, the stream's beginning and end included.

    ``at``: ascending positions where a cut is allowed, from 0 to the end, at most ``capacity`` apart; ``penalty``: in
    tokens, of each.  Of equally good cuts those with fewer windows are taken, then the longer last windows.
    """
    n = len(at)
    number = np.full(int(at[-1]) + 1, -1, np.int32)
    number[at] = np.arange(n)
    ends, starts = [], []
    for k in range(capacity.bit_length()):
        first = int(np.searchsorted(at, 1 << k))
        found = number[at[first:] - (1 << k)]
        hit = np.flatnonzero(found >= 0)
        ends.append(hit + first)
        starts.append(found[hit])
    end, start = np.concatenate(ends), np.concatenate(starts)
    start = start[np.argsort(end, kind="stable")].tolist()
    edges = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n))]).tolist()
    places, fees = at.tolist(), (penalty.astype(np.int64) * TOKEN + 1).tolist()
    best, came = [0] * n, [0] * n
    queue, keys, head = [0], [0], 0  # positions, and f(i) + i, which rises along the queue
    for j in range(1, n):
        p = places[j]
        while places[queue[head]] < p - capacity:
            head += 1
        i, cost = queue[head], keys[head] + (capacity - p) * TOKEN
        for k in start[edges[j] : edges[j + 1]]:
            if best[k] < cost or (best[k] == cost and k < i):
                i, cost = k, best[k]
        came[j], best[j] = i, cost + fees[j]
        key = best[j] + p * TOKEN
        while len(queue) > head and keys[-1] > key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [places[j] for j in reversed(cuts)]


def candidates(ends: np.ndarray, sentences: np.ndarray, capacity: int, stride: int, sentence_penalty: int, inner_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut and at what penalty; ``ends`` are the documents', ``sentences`` the sentences' ends."""
    marks = np.union1d(np.append(0, ends), sentences)
    step = min(stride, capacity)
    more = (np.diff(marks) - 1) // step
    owner = np.repeat(np.arange(len(more)), more)
    nth = np.arange(len(owner)) - (np.cumsum(more) - more)[owner] + 1
    at = np.union1d(marks, marks[owner] + nth * step)
    penalty = np.full(len(at), inner_penalty, np.int64)
    penalty[np.searchsorted(at, sentences)] = sentence_penalty
    penalty[np.searchsorted(at, ends)] = 0
    penalty[0] = 0
    return at, penalty


_ending: dict[str, np.ndarray] = {}


def ending_tokens(c: Codec, vocab: str) -> np.ndarray:
    """For each id whether its token ends a sentence: a full stop, exclamation or question mark, quotes or brackets behind it aside."""
    if vocab not in _ending:
        _ending[vocab] = np.array([b.rstrip().rstrip(b"\"')]}").endswith((b".", b"!", b"?")) for b in c.bytes_of])
    return _ending[vocab]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_windows(docs: DataFrame, vocab: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 1, sentence_penalty: int = 2, inner_penalty: int = 16, stride: int = 128, slice_bytes: int = 4 << 20, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents, in the order of their rows, into windows of at most ``capacity`` tokens.

    A row per piece (the part of a document in a window).  A null or empty text is the single token ``end_id``;
    repeated rows are packed each on its own; a null id stays null; texts of any length are cut at their sentences;
    ties are broken alike everywhere; an empty table gives no rows.  ``keep_ids`` adds the pieces' ids, in the form that ``packing.sequences``
    joins to whole sequences.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, made = codec(vocab), TaskContext.get().partitionId() << 40
        ending = ending_tokens(c, vocab)
        for b in slices(batches, max_bytes=slice_bytes):
            ids, offsets = c.encode_column(column_of(b, "_text"))
            ends = offsets[1:] + np.arange(1, b.num_rows + 1)
            begins = np.append(0, ends[:-1])
            stream = np.insert(ids, offsets[1:], end_id).astype("<u4")
            ended = ending[ids]
            ended[offsets[1:][np.diff(offsets) > 0] - 1] = False  # the document's end follows
            place = np.flatnonzero(ended)
            sentences = place + 1 + np.searchsorted(offsets[1:], place, side="right")
            cuts = np.array(best_cuts(*candidates(ends, sentences, capacity, stride, sentence_penalty, inner_penalty), capacity))
            edges = np.union1d(cuts, ends)
            starts, stops = edges[:-1], edges[1:]
            if len(edges) == 1:
                continue
            doc, window = np.searchsorted(ends, starts, side="right"), np.searchsorted(cuts, starts, side="right") - 1
            raw = memoryview(stream.tobytes())
            columns = [
                column_of(b, "_id").take(pa.array(doc)),
                pa.array(starts - begins[doc], pa.int64()),
                pa.array(stops - starts, pa.int64()),
                pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)], pa.int64()),
                pa.array((ends - begins)[doc], pa.int64()),
                pa.array(made + window, pa.int64()),
                pa.array(starts - cuts[window], pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(stream.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)
            made += len(cuts) - 1

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
