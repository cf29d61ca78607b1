"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A solution is a list of bins (groups of pieces).  Crossover injects whole well-filled bins of one parent into the
other, removes the bins that duplicate their pieces, and puts the displaced pieces back: first in exchange for smaller
pieces, where a bin becomes fuller by it, and then by best fit.

1. Each task packs the pieces that it tokenises in blocks.  Best fit leaves some bins underfilled; these, with as many
   full ones, are what the genetic search works on, group by group.  Full bins are final, and the pieces of the others go on.
2. What all tasks have left is dealt to new blocks.  Islands, tasks of their own, hold a population for each block;
   between epochs every island's elite migrates to the next island, and the best solution of all islands is taken.
"""

from __future__ import annotations

import random
import zlib
from bisect import insort
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import column_of, id_text, shared_checkpoint, slices

Bins = list[list[int]]
Solution = tuple[Bins, list[int]]  # bins of item numbers, and the room left in each
#: Pieces that a population works on at once; what best fit leaves underfilled is worked off in groups of so many.
SEARCHED = 256


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins | None = None, rooms: list[int] | None = None) -> Solution:
    """Put items, in the given order, each into the open bin with the least sufficient room, or a new bin.

    Bins are found by a bitmap of the rooms in use, so that each item takes constant time.
    """
    bins, rooms = bins if bins is not None else [], rooms if rooms is not None else []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for b, room in enumerate(rooms):
        by_room[room].append(b)
        used |= 1 << room
    used &= ~1
    for i in items:
        size = sizes[i]
        above = used >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            rooms.append(0)
        room -= size
        rooms[b] = room
        if room:
            by_room[room].append(b)
            used |= 1 << room
    return bins, rooms


def exchange(displaced: list[int], sizes: list[int], capacity: int, bins: Bins, rooms: list[int]) -> list[int]:
    """Put displaced pieces, the largest first, in exchange for smaller ones where this makes a bin fuller.

    The bin that becomes fullest is taken; the pieces that are displaced by it come up for exchange in turn.
    """
    waiting = sorted(displaced, key=sizes.__getitem__)
    out: list[int] = []
    while waiting:
        d = waiting.pop()
        best = None
        for k, room in enumerate(rooms):
            if room:
                for n, i in enumerate(bins[k]):
                    left = room - (sizes[d] - sizes[i])
                    if 0 <= left < room and (best is None or left < best[0]):
                        best = (left, k, n)
                if best is not None and not best[0]:
                    break
        if best is None:
            out.append(d)
        else:
            left, k, n = best
            bins[k][n], freed = d, bins[k][n]
            rooms[k] = left
            insort(waiting, freed, key=sizes.__getitem__)
    return out


def crossover(a: Solution, b: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """A child of ``a`` that holds a share of the better filled half of the bins of ``b``."""
    limit = sorted(b[1])[len(b[1]) // 2]
    picked = [k for k, room in enumerate(b[1]) if room <= limit and rng.random() < 0.5]
    injected = {i for k in picked for i in b[0][k]}
    bins, rooms, displaced = [list(b[0][k]) for k in picked], [b[1][k] for k in picked], []
    emptiest = max(a[1])
    for group, room in zip(*a, strict=True):
        if not injected.isdisjoint(group) or (room and room == emptiest):
            displaced += [i for i in group if i not in injected]
        else:
            bins.append(list(group))
            rooms.append(room)
    displaced = exchange(displaced, sizes, capacity, bins, rooms)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, bins, rooms)


def fitness(solution: Solution, capacity: int) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (less is better)."""
    return len(solution[0]), -sum((capacity - r) ** 2 for r in solution[1])


def fewest(sizes: list[int], capacity: int) -> int:
    """Bins that no solution has less of."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def settle(sizes: list[int], capacity: int, rng: random.Random, population: int, elites: list[Solution] | None = None) -> list[Solution]:
    """The first population of an island: best fit of decreasing pieces, of shaken orders, and what has immigrated."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    shaken = [best_fit(sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2)), sizes, capacity) for _ in range(population - 1)]
    return [best_fit(order, sizes, capacity), *shaken][: population - len(elites or [])] + (elites or [])


def evolve(ring: list[Solution], sizes: list[int], capacity: int, rng: random.Random, generations: int) -> list[Solution]:
    """The island's population, the best first, after ``generations`` children; each replaces the worst if it is better."""
    least = fewest(sizes, capacity)
    ranked = sorted(((fitness(s, capacity), s) for s in ring), key=lambda x: x[0])
    for _ in range(generations):
        if len(ranked) < 2 or ranked[0][0][0] <= least:
            break
        (_, a), (_, b) = rng.sample(ranked, 2)
        child = crossover(a, b, sizes, capacity, rng)
        fit = fitness(child, capacity)
        if fit < ranked[-1][0] and all(fit != f for f, _ in ranked):
            ranked[-1] = (fit, child)
            ranked.sort(key=lambda x: x[0])
    return [s for _, s in ranked]


def groups_of(solution: Solution, sizes: list[int], capacity: int, slack: int, rng: random.Random, most: int) -> list[list[int]]:
    """Bins to be searched together: all that are underfilled, each with a full one, in groups of about ``most`` pieces.

    There are none where the solution has as few bins as any, and groups that cannot save a bin are left out.
    """
    bins, rooms = solution
    if len(bins) <= fewest(sizes, capacity):
        return []
    under = [k for k, room in enumerate(rooms) if room > slack]
    full = [k for k, room in enumerate(rooms) if room <= slack]
    rng.shuffle(under)
    rng.shuffle(full)
    out: list[list[int]] = [[]]
    held = 0
    for k in [x for pair in zip_longest(under, full[: len(under)]) for x in pair if x is not None]:
        if held + len(bins[k]) > most and len(out[-1]) > 1:
            out.append([])
            held = 0
        out[-1].append(k)
        held += len(bins[k])
    return [g for g in out if len(g) > 1 and len(g) > fewest([sizes[i] for k in g for i in bins[k]], capacity)]


def searched_in(solution: Solution, groups: list[list[int]], sizes: list[int], search: Callable[[list[int], list[int]], Solution]) -> Solution:
    """The solution with what a search (of the items of a group, and their sizes) finds in the place of each group."""
    gone = {k for g in groups for k in g}
    bins, rooms = ([x[k] for k in range(len(x)) if k not in gone] for x in solution)
    for g in groups:
        items = [i for k in g for i in solution[0][k]]
        found = search(items, [sizes[i] for i in items])
        bins += [[items[i] for i in group] for group in found[0]]
        rooms += found[1]
    return bins, rooms


def decreasing(sizes: list[int], capacity: int) -> Solution:
    return best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)


def pack_block(sizes: list[int], capacity: int, seed: int = 0, islands: int = 2, population: int = 4, epochs: int = 2, generations: int = 10, slack: int = 2, searched: int = SEARCHED) -> Solution:
    """Pack one bounded block: best fit, and genetic searches of all that it leaves underfilled, about ``searched`` pieces at a time."""
    rng = random.Random(seed)
    first = decreasing(sizes, capacity)

    def search(items: list[int], own: list[int]) -> Solution:
        rings = [settle(own, capacity, rng, population) for _ in range(islands)]
        for _ in range(epochs):
            rings = [evolve(ring, own, capacity, rng, generations) for ring in rings]
            for ring, elite in zip(rings, [rings[-1][0], *[r[0] for r in rings[:-1]]], strict=True):
                ring[-1] = elite  # elites move on to the next island
        return min((s for ring in rings for s in ring), key=lambda s: fitness(s, capacity))

    groups = groups_of(first, sizes, capacity, slack, rng, searched) if generations else []
    return min(searched_in(first, groups, sizes, search), first, key=lambda s: fitness(s, capacity))


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def placed(sizes: list[int], solution: Solution, first: int, slack: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; -1 (left open) in bins with more room than ``slack``."""
    sequence, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    for k, (group, room) in enumerate(zip(*solution, strict=True)):
        if slack is None or room <= slack:
            at = 0
            for i in group:
                sequence[i], offset[i] = first + k, at
                at += sizes[i]
    return sequence, offset


def solution_of(numbers: list[int], sizes: list[int], capacity: int) -> Solution:
    """The solution in which each piece is in the bin of its number (the form in which elites migrate)."""
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        groups.setdefault(k, []).append(i)
    return list(groups.values()), [capacity - sum(sizes[i] for i in g) for g in groups.values()]


#: The order in which a block's pieces are numbered; pieces that tie in all of it are alike.
NUMBERED = ["length", "doc_id", "piece", "start", "ids_crc32"]


def search_islands(blocks: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int, searched: int = SEARCHED) -> DataFrame:
    """``_block, _bins``: for each block (``_block, _sizes``) the bin numbers of its pieces in the best solution of all islands.

    All islands of a block search the same groups of what best fit leaves underfilled, one after the other until none is left.  A row is
    an island of a block, so that islands are spread over tasks.  After each epoch their elites are written, and each
    joins the island that follows its own.
    """
    schema = "_block long, _island int, _sizes array<int>, _bins array<int>, _fit array<long>"

    def live(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for block, island, sizes, elite in zip(pdf["_block"], pdf["_island"], pdf["_sizes"], pdf["_elites"], strict=True):
                    sizes = [int(x) for x in sizes]
                    rng = random.Random(f"{block} {island} {epoch}")
                    best = decreasing(sizes, capacity)
                    groups = groups_of(best, sizes, capacity, 0, random.Random(int(block)), searched) if generations else []
                    elites = elite if elite is not None else ()

                    def search(items: list[int], own: list[int], rng: random.Random = rng, elites: tuple = elites) -> Solution:
                        immigrants = [solution_of([e[i] for i in items], own, capacity) for e in elites]
                        return evolve(settle(own, capacity, rng, population, immigrants), own, capacity, rng, generations)[0]

                    best = min(searched_in(best, groups, sizes, search), best, key=lambda s: fitness(s, capacity))
                    numbers = np.zeros(len(sizes), np.int32)
                    for k, group in enumerate(best[0]):
                        numbers[group] = k
                    out.append((block, island, sizes, numbers.tolist(), list(fitness(best, capacity))))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

        return run

    spread = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island"), F.lit(None).cast("array<array<int>>").alias("_elites"))
    for epoch in range(epochs):
        # one island a task, as far as there are tasks
        lived = shared_checkpoint(spread.repartition("_block", "_island").mapInPandas(live(epoch), schema))
        elites = lived.select("_block", "_island", "_bins").unionByName(lived.select("_block", ((F.col("_island") + 1) % islands).alias("_island"), "_bins"))
        elites = elites.groupBy("_block", "_island").agg(F.collect_set("_bins").alias("_elites"))
        spread = lived.select("_block", "_island", "_sizes").join(elites, ["_block", "_island"])
    return lived.groupBy("_block").agg(F.min_by("_bins", F.struct("_fit", "_island")).alias("_bins"))


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, block: int = 8192, slack: int = 2, islands: int = 3, epochs: int = 2, generations: int = 20, population: int = 4, searched: int = SEARCHED, slice_bytes: int = 8 << 20, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A row per piece.  A null or empty text is the single token ``end_id``; repeated rows are packed each on
    its own; a null id stays null; an empty table gives no rows.  ``keep_ids`` adds the pieces' ids.
    Texts are tokenised in slices of ``slice_bytes``, which bound a worker's memory, or one by one where they are longer.
    ``generations=0`` leaves it at best fit; ``searched`` is how many pieces a search has before it at once.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pid, made = codec(vocab), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            sizes = [h[3] for h in held]
            sequence, offset = placed(sizes, pack_block(sizes, capacity, pid, generations=generations // 2, slack=slack, searched=searched), pid << 32 | made, slack)
            made += len(held)
            cols = [pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            cols += [pa.array(sequence), pa.array(offset)]
            if keep_ids:
                cols.append(pa.array([h[5] for h in held], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)
            held = []

        for b in slices(batches, max_bytes=slice_bytes):
            ids, offsets = c.encode_column(column_of(b, "_text"))
            edges = offsets.tolist()
            for doc, i, j in zip(column_of(b, "_id").to_pylist(), edges[:-1], edges[1:], strict=True):
                own = np.append(ids[i:j], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    held.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None))
                if len(held) >= block:
                    yield from flush()
        if held:
            yield from flush()

    names = [x.split()[0] for x in schema.split(", ")]
    packed = shared_checkpoint(id_text(docs, id_col, text_col).mapInArrow(tokenize, schema))
    done, left = packed.filter("sequence_id >= 0"), packed.filter("sequence_id < 0")
    blocks = -(-left.count() // block)
    if not blocks:
        return done
    dealt = left.withColumn("_block", F.expr(f"pmod(monotonically_increasing_id(), {blocks})"))
    sizes = dealt.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct(*NUMBERED))).alias("_p")).select("_block", F.transform("_p", lambda p: p["length"].cast("int")).alias("_sizes"))
    best = search_islands(sizes, capacity, islands, epochs, generations, population, searched)

    def last(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        pdf = pdf.sort_values(NUMBERED, na_position="first", kind="stable")
        own = pdf["length"].tolist()
        sequence, offset = placed(own, solution_of(list(found["_bins"].iloc[0]), own, capacity), 1 << 62 | number << 32)
        return pdf.assign(sequence_id=sequence, offset=offset)[names]

    return done.unionByName(dealt.groupBy("_block").cogroup(best.groupBy("_block")).applyInPandas(last, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """Whole token sequences of a packing made with ``keep_ids``: ``sequence_id, n_tokens, ids`` (bounded by the capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
