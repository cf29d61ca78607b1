"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from one part of the training rows by log-odds; the trees are
grown on another part and calibrated on a third.  Scores depend on the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, id_text, shared_checkpoint, slices, texts_of, words_of
from .labelled import TRAIN_ROWS, held_out, sums_by_text, training_sample

#: Pronouns of the second person in the corpus' languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton vous votre ti usted ustedes vosotros".split())
SIGNS = "!?.,;:'\"()[]{}*_-#%&|<>~"
LEET = str.maketrans("013457@$!", "oieastasi")
NEAR = 5
#: Bytes of text that are looked at at once, and words whose forms a worker keeps.
SLICE, CACHED = 2 << 20, 40_000


def stems(word: str) -> list[str]:
    """The forms under which a word is looked up: the whole word, and its first four to six letters."""
    bare = word.strip(SIGNS)
    if bare and not bare.isalpha():
        bare = "".join(c for c in bare.translate(LEET) if c.isalpha())
    return [bare, *(f"{bare[:k]}+" for k in (4, 5, 6) if len(bare) > k)] if len(bare) > 2 else []


def learn_lexicon(sample: DataFrame, ids: np.ndarray, y: np.ndarray, least: int = 4, odds: float = 2.0, most: int = 5000) -> dict[str, float]:
    """Log-odds of the forms that mark the labelled texts of ``ids`` (sorted) most surely; at most ``most`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        cache: dict[str, list[str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(seen[0].keys() | seen[1].keys())
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[f] for f in some], pa.int64()) for c in seen)], ["_form", "_n0", "_n1"])
            for c in seen:
                c.clear()

        for b in slices(batches, max_bytes=SLICE):
            for text, label in zip(texts_of(b), column_of(b, "_y").to_pylist(), strict=True):
                forms: set[str] = set()
                for w in set(text.lower().split()):
                    if w not in cache:
                        cache[w] = stems(w)
                    forms.update(cache[w])
                seen[label].update(forms)
                if len(cache) > CACHED:
                    cache.clear()
            if len(seen[0]) + len(seen[1]) > 2 * CACHED:  # bounded memory: counts are added up later
                yield from flush()
        yield from flush()

    bad, good = int(y.sum()), len(y) - int(y.sum())
    rows = rows_of(sample, ids).mapInArrow(count, "_form string, _n0 long, _n1 long").groupBy("_form").agg(F.sum("_n0").alias("_n0"), F.sum("_n1").alias("_n1"))
    value = F.log((F.col("_n1") + 0.5) / (bad + 1)) - F.log((F.col("_n0") + 0.5) / (good + 1))
    rows = rows.filter(F.col("_n1") >= least).withColumn("_value", value).filter(F.col("_value") >= odds).orderBy(F.desc("_value"), "_form").limit(most)
    return {r["_form"]: r["_value"] for r in rows.collect()}


def rows_of(sample: DataFrame, ids: np.ndarray) -> DataFrame:
    """The rows of the sample whose ids are among ``ids`` (a bounded number)."""
    listed = sample.sparkSession.createDataFrame([(int(i),) for i in ids], "_id long")
    return sample.join(F.broadcast(listed), "_id", "left_semi").select("_id", "_y", "_text")


@dataclass
class Trees:
    """Boosted trees of one depth: a feature and a cut for each inner node, a value for each leaf."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # where most values are equal, quantiles miss the tail
    edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, 9)[:-1]) if len(v := x[x[:, j] > x[:, j].min(), j]) else e])) for j, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    width = max(len(e) for e in edges) + 1
    raw = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        inner = 2**depth - 1
        f, c, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * width + binned[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(e)]
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = np.flatnonzero(top > best + 1e-9)
                best[better], f[first + better], c[first + better], cut_bin[first + better] = top[better], j, e[at[better]], at[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), f[node]] > cut_bin[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        value = -rate * gs / (hs + ridge)
        raw += value[leaf]
        model.features.append(f)
        model.cuts.append(c)
        model.leaves.append(value)
    return model


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and never falling probabilities between them (ends smoothed off 0 and 1)."""
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []  # weight, positives, least and most logit
    for v, t in zip(z[order].tolist(), y[order].tolist(), strict=True):
        pools.append([1.0, float(t), v, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, s, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2], hi]
    knots = [(k, (s + 0.1) / (w + 0.2)) for w, s, lo, hi in pools for k in (lo, hi)]
    return np.array([k for k, _ in knots]), np.maximum.accumulate(np.array([p for _, p in knots]))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))
    cache: dict[str, tuple] = field(default_factory=dict)

    def word(self, w: str) -> tuple[float, bool, bool]:
        """Lexicon log-odds (0: not in it), second person, obfuscated."""
        bare = w.strip(SIGNS)
        score = max([self.lexicon.get(s, 0.0) for s in stems(w)], default=0.0)
        odd = len(bare) > 2 and not bare.isalpha() and any(c.isalpha() for c in bare) and not bare.isdigit()
        return score, bare in SECOND_PERSON, odd

    def features(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "")
        index, words, counts = words_of(column)
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache = self.cache
        for w in words:
            if w not in cache:
                cache[w] = self.word(w)
        facts = np.array([cache[w] for w in words], dtype=np.float64).reshape(-1, 3)[index]
        score, second, odd = facts[:, 0], facts[:, 1], facts[:, 2]
        hit = (score > 0).astype(np.float64)
        n = np.maximum(counts, 1)
        # hits with a second-person word within five words, counted within the text
        ends, m = np.cumsum(counts), len(index)
        last = np.repeat(ends, counts)
        first = last - np.repeat(counts, counts)
        before = np.append(0, np.cumsum(second))
        at = np.arange(m)
        near = before[np.minimum(at + NEAR + 1, last)] - before[np.maximum(at - NEAR, first)] > 0
        top = np.zeros(len(counts))
        full = counts > 0
        if full.any():
            top[full] = np.maximum.reduceat(score, (ends - counts)[full])
        data = column.cast(pa.binary())
        sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        share = lambda keep: sums_by_text(keep.astype(np.int64), sizes) / np.maximum(sizes, 1)
        total = lambda v: sums_by_text(v, counts)
        return np.stack(
            [
                top,
                total(score),
                total(score) / n,
                total(hit),
                total(hit) / n,
                total((score > 3).astype(float)),
                total((score > 4.5).astype(float)),
                total(hit * near),
                total(second) / n,
                total(odd) / n,
                share((raw >= 65) & (raw <= 90)),
                share((raw == 33) | (raw == 63)),
                share(np.isin(raw, list(b"#*$%&|<>@"))),
                share((raw >= 48) & (raw <= 57)),
                np.log1p(counts),
                sizes / n,
            ],
            axis=1,
        )

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), float(self.levels[0]))
        return np.interp(self.trees.raw(self.features(column)), self.knots, self.levels)


def fit(sample: DataFrame) -> ToxicityModel:
    """Half of the rows teach the lexicon, a third the trees, the rest the calibration.

    With so few rows that one of these parts lacks a label, all rows teach all three.  Whole texts are counted and
    turned into features where they are; only counts and features reach the driver.
    """
    sample = shared_checkpoint(sample)
    table = sample.select("_id", "_y").toPandas().sort_values("_id")
    ids, y = table["_id"].to_numpy(dtype=np.int64), table["_y"].to_numpy(dtype=np.int64)
    if len(np.unique(y)) < 2:
        return ToxicityModel({}, levels=np.array([float(y[0]) * 0.98 + 0.01 if len(y) else 0.01]))
    part = np.arange(len(y)) % 6
    parts = [part < 3, (part == 3) | (part == 4), part == 5]
    if any(len(np.unique(y[own])) < 2 for own in parts):
        parts = [np.ones(len(y), bool)] * 3
    model = ToxicityModel(learn_lexicon(sample, ids[parts[0]], y[parts[0]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=SLICE):
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), pa.array(list(model.features(column_of(b, "_text"))), pa.list_(pa.float64()))], ["_id", "_x"])

    made = {r["_id"]: r["_x"] for r in rows_of(sample, ids[parts[1] | parts[2]]).mapInArrow(run, "_id long, _x array<double>").collect()}
    gather = lambda keep: (np.array([made[i] for i in ids[keep].tolist()], dtype=np.float64).reshape(int(keep.sum()), -1), y[keep])
    x, t = gather(parts[1])
    model.trees = boost(x, t)
    x, t = gather(parts[2])
    model.knots, model.levels = isotonic(model.trees.raw(x), t)
    model.cache = {}
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text is scored as a text without words.  Repeated rows have equal scores; a null id stays null
    and is not held out.  Without labelled rows of both kinds every score is the labels' constant; labels other than
    0 and 1 do not train.  An empty table gives no rows.
    """
    model = fit(training_sample(docs, labels, "toxic", rows, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max_bytes=SLICE):
            ids = column_of(b, "_id")
            score = model.scores(column_of(b, "_text"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist())), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts are scored below ``threshold`` (a score of just that goes).

    A null text is scored as a text without words; repeated rows stay or go alike; null ids are no matter.
    """
    model = fit(training_sample(docs, labels, "toxic", rows, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, max_bytes=SLICE):
            yield b.filter(pa.array(model.scores(column_of(b, text_col)) < threshold))

    return docs.mapInArrow(run, docs.schema)
