"""Linear filters with feedback that are split within a stream.

Over a block of samples such a filter maps the state it is entered with to the state it is left in by an affine map: a power of its
matrix, plus the state that the block's own samples leave behind.  The maps compose, so that a stream of any length runs in many tasks:

1. each block, entered at rest, gives the state that it leaves;
2. one pass over the blocks of a stream (a row each) gives the state that every block is entered in;
3. each block is filtered from that state.

Within a block the same is done once more in numpy: short lanes run side by side, and what each inherits is added at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65536


@dataclass(frozen=True)
class System:
    """``state' = a state + b x`` and ``y = c state + d x``."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def order(self) -> int:
        return len(self.b)

    def rest(self) -> np.ndarray:
        return np.zeros(self.order)


def biquad(b: tuple[float, float, float], a: tuple[float, float]) -> System:
    """A second-order section; its state are the two sums that wait for the next samples."""
    (b0, b1, b2), (a1, a2) = b, a
    return System(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0)


def smoothing(keep: float) -> System:
    """``y = keep * (y before) + (1 - keep) * x``."""
    return System(np.array([[keep]]), np.array([1 - keep]), np.array([keep]), 1 - keep)


def cascade(*systems: System) -> System:
    """One system after the other, as one."""

    def two(f: System, g: System) -> System:
        a = np.block([[f.a, np.zeros((f.order, g.order))], [np.outer(g.b, f.c), g.a]])
        return System(a, np.append(f.b, g.b * f.d), np.append(g.d * f.c, g.c), f.d * g.d)

    return reduce(two, systems)


def step_by_step(s: System, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = np.empty(len(x))
    for k, v in enumerate(x.tolist()):
        y[k] = s.c @ state + s.d * v
        state = s.a @ state + s.b * v
    return y, state


#: Shorter stretches are filtered step by step.
SHORT = 48


def filtered(s: System, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of a stretch that is entered in a state, and the state it is left in."""
    n = len(x)
    if n < SHORT:
        return step_by_step(s, x, state)
    width = int(np.sqrt(n))
    count = n // width
    lanes = x[: count * width].reshape(count, width)
    y, z = np.empty((count, width)), np.zeros((count, s.order))
    for t in range(width):  # all lanes from rest
        v = lanes[:, t]
        y[:, t] = z @ s.c + s.d * v
        z = z @ s.a.T + v[:, None] * s.b
    heard = np.empty((width, s.order))  # what an entry state adds to each output
    power = np.eye(s.order)
    for t in range(width):
        heard[t] = s.c @ power
        power = s.a @ power
    entered = np.empty((count, s.order))
    for k in range(count):
        entered[k] = state
        state = power @ state + z[k]
    y += entered @ heard.T
    tail, state = step_by_step(s, x[count * width :], state)
    return np.concatenate([y.ravel(), tail]), state


def linear_filter(samples: DataFrame, system: System, name: str, key: tuple[str, ...] = ("stream",), value: str = "x", scale: float = 1 / 32768.0, magnitude: bool = False, from_first: bool = False, block: int = BLOCK) -> DataFrame:
    """The key, ``i`` and the filter's output for each sample of each stream, in order of ``i``.

    With ``magnitude`` the filter gets absolute values; with ``from_first`` it is entered as if the first sample had
    stood there for ever (for smoothing), otherwise at rest.
    """
    x = F.col(value).cast("double") * scale
    own = [*[F.col(k).cast("long").alias(k) for k in key], F.col("i").cast("long").alias("i"), (F.abs(x) if magnitude else x).alias("_x")]
    rows = samples.select(*own).withColumn("_b", F.expr(f"i div {block}"))
    cut = rows.repartition(*key, "_b").sortWithinPartitions(*key, "_b", "i")
    keys = ", ".join(f"{k} long" for k in key)
    first = lambda v: np.full(system.order, v) if from_first else system.rest()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, xs in stretches(batches, [*key, "_b"]):
            left = filtered(system, xs, system.rest())[1]
            yield _row([*own, len(xs), float(xs[0]), left.tolist()], [*key, "_b", "_n", "_first", "_left"], [*[pa.int64()] * (len(key) + 2), pa.float64(), pa.list_(pa.float64())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "_b", "_n", "_first", "_left"]
        for _, group in groupby((r for b in batches for r in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in names], strict=True)), key=lambda r: r[: len(key)]):
            state = None
            for *own, n, opening, left in group:
                state = first(opening) if state is None else state
                yield _row([*own, state.tolist()], [*key, "_b", "_state"], [*[pa.int64()] * (len(key) + 1), pa.list_(pa.float64())])
                state = np.linalg.matrix_power(system.a, n) @ state + np.array(left)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, places, xs in stretches(batches, [*key, "_b"]):
            yield _row([*own, places, xs], [*key, "_b", "_i", "_x"], [*[pa.int64()] * (len(key) + 1), pa.list_(pa.int64()), pa.list_(pa.float64())])

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            counts = np.diff(column("_x").offsets.to_numpy())
            x, states = column("_x").flatten().to_numpy(zero_copy_only=False), column("_state").to_pylist()
            edges = np.append(0, np.cumsum(counts)).tolist()
            y = [filtered(system, x[i:j], np.array(s))[0] for i, j, s in zip(edges[:-1], edges[1:], states, strict=True)]
            owner = pa.array(np.repeat(np.arange(b.num_rows), counts))
            yield pa.RecordBatch.from_arrays([*[column(k).take(owner) for k in key], column("_i").flatten(), pa.array(np.concatenate(y) if y else np.zeros(0))], [*key, "i", name])

    left = batched(cut, summaries, f"{keys}, _b long, _n long, _first double, _left array<double>")
    states = batched(left.repartition(*key).sortWithinPartitions(*key, "_b"), entries, f"{keys}, _b long, _state array<double>")
    blocks = batched(cut, packed, f"{keys}, _b long, _i array<long>, _x array<double>")
    same = [F.col(f"_k{n}").eqNullSafe(F.col(k)) for n, k in enumerate(key)]
    states = states.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], F.col("_b").alias("_kb"), "_state")
    joined = blocks.join(states, [*same, F.col("_b") == F.col("_kb")]).select(*key, "_i", "_x", "_state")
    return joined.mapInArrow(outputs, f"{keys}, i long, {name} double")


def stretches(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The key, places and values of each block of sorted rows; a block is bounded."""
    now, places, values = None, [], []
    for b in batches:
        column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
        keys = [column(k) for k in key]
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            v = k.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        i, x = column("i").to_numpy(zero_copy_only=False), column("_x").to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows] if b.num_rows else []
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(k[start].as_py() for k in keys)
            if now is not None and own != now:
                yield now, np.concatenate(places), np.concatenate(values)
                places, values = [], []
            now = own
            places.append(i[start:stop])
            values.append(x[start:stop])
    if now is not None:
        yield now, np.concatenate(places), np.concatenate(values)


def _row(values: list, names: list[str], types: list[pa.DataType]) -> tuple[list, list[str], list[pa.DataType]]:
    return values, names, types


def batched(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows that a generator gives one by one, in Arrow batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for values, names, types in make(batches):
            held.append(values)
            size += 64 + sum(len(v) * 8 for v in values if hasattr(v, "__len__"))
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(types)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(types)], names)

    return rows.mapInArrow(run, schema)
