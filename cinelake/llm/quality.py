"""Quality rules: exact base counts, and a hashed word and character n-gram logistic regression.

The regression averages hashed weights over each family of n-grams of the whole text (words, word pairs, byte
four-grams), is fitted on a bounded sample of labelled rows, probability-calibrated on rows kept apart, and scored
in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column_of, id_text, mix64, slices, word_hashes, words_of
from .labelled import batches_of, sums_by_text, training_rows

#: Most labelled rows, whole texts, that the regression is fitted on: their n-grams are held on the driver.
TRAIN_ROWS = 4000
BITS = 16
SYMBOLS = b"#*$%&|<>"
THRESHOLD = 0.5


def bucket(h: np.ndarray) -> np.ndarray:
    return (mix64(h) >> np.uint64(64 - BITS)).astype(np.int32)


def gram_families(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family of n-grams: the bucket of each n-gram of all texts, and the number of n-grams per text."""
    index, words, counts = words_of(column)
    hashes = word_hashes(words)[index]
    n = len(hashes)
    ends = np.cumsum(counts)
    pair_ok = np.ones(max(0, n - 1), bool)
    pair_ok[ends[(ends > 0) & (ends < n)] - 1] = False
    pairs = bucket(hashes[:-1] * np.uint64(3) + hashes[1:])[pair_ok] if n > 1 else np.zeros(0, np.int32)
    data = pc.fill_null(column.cast(pa.binary()), b"")
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8).astype(np.uint32)
    m = len(raw)
    if m >= 4:
        four = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        inside = np.ones(m, bool)
        byte_ends = np.cumsum(sizes)
        for k in (1, 2, 3):  # grams that would reach into the next text
            at = byte_ends - k
            inside[at[(at >= 0) & (sizes >= k)]] = False
        grams = ((four * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)[inside[: m - 3]]
    else:
        grams = np.zeros(0, np.int32)
    return [(bucket(hashes), counts), (pairs, np.maximum(counts - 1, 0)), (grams, np.maximum(sizes - 3, 0))]


@dataclass
class QualityModel:
    weights: np.ndarray  # families x buckets
    bias: float
    scale: float
    shift: float

    def logits(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        for w, (grams, counts) in zip(self.weights, gram_families(column), strict=True):
            total += sums_by_text(w[grams].astype(np.float64), counts) / np.maximum(counts, 1)
        return total

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(column) + self.shift, -30, 30)))


def fit(texts: list[str], y: np.ndarray, steps: int = 80, rate: float = 0.5, l2: float = 1e-6) -> QualityModel:
    """Logistic regression by Adam on all training rows, and Platt calibration on every fourth row, kept apart."""
    width = 1 << BITS
    if len(np.unique(y)) < 2:  # nothing to learn: the constant that the labels say
        only = float(y[0]) if len(y) else 1.0
        return QualityModel(np.zeros((3, width), np.float32), 0.0, 0.0, 6.0 if only else -6.0)
    cols, rows, vals, done = [], [], [], 0
    for column in batches_of(texts):
        for f, (grams, counts) in enumerate(gram_families(column)):
            owner = np.repeat(np.arange(len(counts)), counts)
            key, n = np.unique(owner.astype(np.int64) * width + grams, return_counts=True)
            rows.append((key // width + done).astype(np.int32))
            cols.append((key % width + f * width).astype(np.int32))
            vals.append((n / np.maximum(counts, 1)[key // width]).astype(np.float32))
        done += len(column)
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    rows, cols, vals = [], [], []
    part = np.arange(len(y)) % 4 == 3
    train = ~part
    share = y[train].mean()
    cost = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) * train / train.sum()
    w, b = np.zeros(3 * width), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col] * val, minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        gw, gb = np.bincount(col, weights=g[row] * val, minlength=3 * width) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = rate / (1 - 0.9**t)
        w -= fix * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.1 * fix * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    z = (np.bincount(row, weights=w[col] * val, minlength=len(y)) + b)[part]
    scale, shift = platt(z, y[part])
    return QualityModel(w.reshape(3, width).astype(np.float32), b, scale, shift)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of logits by Newton steps on smoothed targets."""
    if not len(y):
        return 1.0, 0.0
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = z.std() or 1.0
    a, b = 1.0 / spread, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        ga, gb = (d * z).sum() + 1e-3 * a, d.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a - 0.7 * (hbb * ga - hab * gb) / det, b - 0.7 * (haa * gb - hab * ga) / det
    return float(a), float(b)


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The exact base counts of each text."""
    index, words, counts = words_of(column, lower=False)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = pc.fill_null(column.cast(pa.binary()), b"")
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS)] = 1
    dup = []
    for text in texts_of_array(column):
        seen: set[str] = set()
        n = 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in seen:
                    n += 1
                elif line.strip(" \t\n\x0b\x0c\r"):
                    seen.add(line)
        dup.append(n)
    # Words in five-word windows whose words occur at least twice in the text.
    hashes = word_hashes(words)[index]
    n = len(hashes)
    repeat = np.zeros(n, np.int64)
    if n >= 5:
        window = np.zeros(n - 4, np.uint64)
        for k in range(5):
            window = mix64(window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - 4 + k])
        owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        whole = np.flatnonzero(owner[: n - 4] == owner[4:])
        key = mix64(window[whole] + owner[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = whole[order[np.append(same, False) | np.append(False, same)]]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, np.minimum(twice + 5, n), -1)
        repeat = (np.cumsum(edge)[:n] > 0).astype(np.int64)
    return {
        "n_words": counts,
        "word_chars": sums_by_text(lengths[index], counts),
        "n_symbols": sums_by_text(table[raw], sizes),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": sums_by_text(repeat, counts),
    }


def texts_of_array(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, their verdict, the model's ``quality`` probability, and ``kept`` for every row.

    A null or empty text has no words and fails the base rules.  Repeated rows and null ids are scored like any
    other.  Without labelled rows of both kinds the model keeps what its labels say (all, if there are none).
    """
    model = fit(*training_rows(docs, labels, "quality", rows, id_col, text_col))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=4 << 20):
            column = pc.fill_null(column_of(b, "_text"), "")
            base = base_counts(column)
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            score = model.scores(column)
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), *map(pa.array, base.values()), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names)

    counts = ", ".join(f"{n} long" for n in names[:6])
    return id_text(docs, id_col, text_col).mapInArrow(run, counts + ", base_failed boolean, kept boolean, quality double")


