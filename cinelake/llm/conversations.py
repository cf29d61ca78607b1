"""Conversation structure repair by a run-length dynamic program in the min-plus semiring.

What has been read of a repaired conversation is one of four states: nothing yet, a system, a user or an assistant turn.  A turn is a
symbol (its role's initial and its fault); a symbol's least costs from state to state are a 4 x 4 min-plus matrix.  Equal consecutive symbols
are collapsed to runs, and a run of n is the n-th power of its matrix, put together from cached binary powers.

Matrices compose, so no conversation has to be in one task: turns are sorted by range, over as many tasks as it takes, and cut in blocks
of at most ``BLOCK`` rows.

1. ``numbered_blocks``: a block's rows, matrix, fault counts and edges.
2. ``exit_costs``: per conversation, from its last block to its first, the least cost to go behind each block.
3. ``paths``: with it, the choices within each block, unrolled from every state that it can be entered in.
4. ``chosen``: per conversation, from its first block on, the state in which each block is entered.

Only summaries of blocks meet per conversation, never its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, give_back, shared_checkpoint

BLOCK = 65536
FAR = 1 << 40
#: States: nothing yet, after a system, a user, an assistant turn.  The turn that is due in each is a user's but after a user's.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Symbol 0 is a turn that has to go; others are 1 + 2 * (place of the role's initial, all others last) + truncated.
GONE, INITIALS = 0, "sua"
ENTERED_BY = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}


def symbol_of(role: str, truncated: bool) -> int:
    place = INITIALS.find(role[:1]) if role else -1
    return 1 + 2 * (place if place >= 0 else len(INITIALS)) + truncated


def kept_state(symbol: int, state: int) -> int | None:
    """The state after a turn that is kept as it is, if it may be."""
    place = (symbol - 1) // 2
    return ENTERED_BY[INITIALS[place]].get(state) if symbol and place < len(INITIALS) else None


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of cost matrices, or of a matrix and a column of costs to go."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _inserted() -> np.ndarray:
    """Costs of inserting any number of turns."""
    one = np.full((4, 4), FAR, np.int64)
    one[range(4), range(4)] = 0
    one[range(4), DUE] = INSERT
    return min_plus(one, one)


INSERTED = _inserted()
#: Costs to go at the end of a conversation: it may be empty or end with an assistant's turn.
END = min_plus(INSERTED, np.array([[0], [FAR], [FAR], [0]], np.int64))


def step(symbol: int) -> np.ndarray:
    """Least costs from state to state over a turn and the insertions before it."""
    own = np.full((4, 4), FAR, np.int64)
    own[range(4), range(4)] = DELETE
    if symbol != GONE:
        fee = TRUNCATED * ((symbol - 1) % 2)
        for state in range(4):
            own[state, DUE[state]] = min(own[state, DUE[state]], REROLE + fee)
            after = kept_state(symbol, state)
            if after is not None:
                own[state, after] = min(own[state, after], fee)
    return min_plus(INSERTED, own)


_powers: dict[int, list[np.ndarray]] = {}


def power(symbol: int, k: int) -> np.ndarray:
    """The matrix of 2**k equal turns, cached."""
    known = _powers.setdefault(symbol, [step(symbol)])
    while len(known) <= k:
        known.append(min_plus(known[-1], known[-1]))
    return known[k]


def advance(symbol: int, length: int, costs: np.ndarray) -> np.ndarray:
    """Costs to go before a run, from those behind it (a column, or a matrix of several)."""
    if symbol == GONE:  # only deletions, and nothing is gained by inserting before one
        return np.minimum(costs + DELETE * length, FAR)
    for k in range(length.bit_length()):
        if length >> k & 1:
            costs = min_plus(power(symbol, k), costs)
    return costs


def all_costs(symbol: int, length: int, costs: np.ndarray) -> np.ndarray:
    """Costs to go with 0, 1, ... ``length`` turns of a run still to come (a row each), by doubling."""
    out, k = costs.reshape(1, 4), 0
    while len(out) <= length:
        out, k = np.concatenate([out, min_plus(power(symbol, k), out.T).T]), k + 1
    return out[: length + 1]


def runs_of(symbols: list[int], copies: list[int]) -> list[tuple[int, int]]:
    """(symbol, length) of equal consecutive turns; a row is its own symbol and then its copies, which have to go."""
    out: list[list[int]] = []
    for s, n in zip(symbols, copies, strict=True):
        for symbol, length in ((s, 1), (GONE, n - 1)) if s != GONE else ((GONE, n),):
            if length > 0:
                if out and out[-1][0] == symbol:
                    out[-1][1] += length
                else:
                    out.append([symbol, length])
    return [(s, n) for s, n in out]


def matrix_of(runs: list[tuple[int, int]]) -> np.ndarray:
    costs = np.full((4, 4), FAR, np.int64)
    costs[range(4), range(4)] = 0
    for symbol, length in reversed(runs):
        costs = advance(symbol, length, costs)
    return costs


#: Rows up to which a block's results are kept for other blocks with the same symbols, and how many are kept.
SHORT, KEPT = 32, 1 << 14


@lru_cache(KEPT)
def short_matrix(runs: tuple[tuple[int, int], ...]) -> list[int]:
    return matrix_of(list(runs)).ravel().tolist()


def flat_matrix(runs: list[tuple[int, int]]) -> list[int]:
    """The matrix of a block's runs, row by row; conversations are often alike, so that short ones are looked up."""
    return short_matrix(tuple(runs)) if len(runs) <= SHORT else matrix_of(runs).ravel().tolist()


def choose(symbol: int, state: int, now: list[int], after: list[int]) -> tuple[str, str, int]:
    """The ASCII-least cheapest edits up to and with a turn: letters, what they put out, and the next state.

    Outputs: u, a an inserted turn; U, A the turn with another role; K the turn as it is.
    """
    letters = outs = ""
    fee = TRUNCATED * ((symbol - 1) % 2)
    while True:
        cost, due = now[state], DUE[state]
        if DELETE + after[state] == cost:
            return letters + "D", outs, state
        if INSERT + now[due] == cost:
            letters, outs, state = letters + "I", outs + ROLES[due][0], due
            continue
        kept = kept_state(symbol, state)
        if kept is not None and fee + after[kept] == cost:
            return letters + "K", outs + "K", kept
        return letters + "R", outs + ROLES[due][0].upper(), due


def unroll(symbols: list[int], copies: list[int], costs: np.ndarray, state: int, last: bool) -> tuple[list[str], list[str], int]:
    """Letters and outputs of each row of a block that is entered in a state, and the state behind it.

    A row's letters end with those of the turn itself, its copies not counted; insertions at the conversation's end
    follow the last row's.
    """
    runs = runs_of(symbols, copies)
    behind = []
    for symbol, length in reversed(runs):
        behind.append(costs)
        costs = advance(symbol, length, costs)
    stacks = iter((symbol, length, c) for (symbol, length), c in zip(runs, reversed(behind), strict=True))
    letters, outs, stack = [], [], []
    left = 0
    for s, n in zip(symbols, copies, strict=True):
        own, put = "", ""
        for symbol, length in ((s, 1), (GONE, n - 1)) if s != GONE else ((GONE, n),):
            if length <= 0:
                continue
            if not left:
                run, left, c = next(stacks)
                stack = all_costs(run, left, c).tolist() if run != GONE else []
            if symbol != GONE:
                own, put, state = choose(symbol, state, stack[left], stack[left - 1])
            left -= length
        letters.append(own)
        outs.append(put)
    if last and letters:
        end = END[:, 0].tolist()
        while end[state]:
            state = DUE[state]
            letters[-1] += "+I"  # behind the row's copies
            outs[-1] += "+" + ROLES[state][0]
    return letters, outs, state


@lru_cache(KEPT)
def short_unroll(symbols: tuple[int, ...], copies: tuple[int, ...], costs: tuple[int, ...], state: int, last: bool) -> tuple[list[str], list[str], int]:
    return unroll(list(symbols), list(copies), np.array(costs, np.int64).reshape(4, 1), state, last)


def choices(symbols: list[int], copies: list[int], costs: list[int], state: int, last: bool) -> tuple[list[str], list[str], int]:
    """``unroll`` of a block, looked up where it is short."""
    if len(symbols) <= SHORT:
        return short_unroll(tuple(symbols), tuple(copies), tuple(costs), state, last)
    return unroll(symbols, copies, np.array(costs, np.int64).reshape(4, 1), state, last)


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damaged rows ``_c, _t, _r, _text, n``, by a checksum of ``conversation:turn``; ``n`` is how often a row then stands there.

    Of twenty checksums one drops the row (n = 0), one empties its text, one takes its full stops, exclamation and
    question marks, one repeats it (n = 2) and one gives it to the user.  Nulls count as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).cast("string").alias("_c"), F.col(turn_col).cast("long").alias("_t"), blank(role_col).alias("_r"), blank(text_col).alias("_text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("_c", "_t", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_r")).alias("_r"), text.alias("_text"), copies.alias("n"))


def as_they_are(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns of conversations that are not damaged on purpose."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).cast("string").alias("_c"), F.col(turn_col).cast("long").alias("_t"), blank(role_col).alias("_r"), blank(text_col).alias("_text"), F.lit(1).cast("long").alias("n"))


def content_key() -> Column:
    return F.unhex(F.md5(F.concat(F.char_length("_r").cast("string"), F.lit(":"), F.col("_r"), F.col("_text")).cast("binary")))


def faults(rows: DataFrame) -> DataFrame:
    """Without texts: ``_c, _t, _r, _d, n, _blank, _cut, _first``; equal rows are one, ``_d`` tells contents apart.

    ``_first``: the first copy is the first of its role and text.  First turns are aggregated per content and matched by content
    and turn, so that a content that fills a conversation is not dealt to one task.
    """
    blank = ~F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    keys = ["_c", "_t", "_r", "_d"]
    rows = rows.select("_c", "_t", "_r", content_key().alias("_d"), "n", blank.alias("_blank"), cut.alias("_cut"))
    rows = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("_blank").alias("_blank"), F.max("_cut").alias("_cut"))
    first = rows.filter("n > 0 and not _blank").groupBy("_c", "_r", "_d").agg(F.min(F.struct("_t")).alias("_f"))
    first = first.select(F.col("_c").alias("_fc"), F.col("_f._t").alias("_ft"), F.col("_r").alias("_fr"), F.col("_d").alias("_fd"), F.lit(True).alias("_first"))
    same = F.expr("_c <=> _fc AND _t <=> _ft AND _r = _fr AND _d = _fd")
    return rows.join(first, same, "left").select(*keys, "n", "_blank", "_cut", F.coalesce("_first", F.lit(False)).alias("_first"))


BLOCKS = "_c string, _b long, _turns array<long>, _roles array<string>, _keys array<binary>, _copies array<long>, _symbols array<int>, _matrix array<long>, _stats array<long>, _edges array<string>"


def summary(turns: list, roles: list[str], copies: list[int], blanks: list[bool], cuts: list[bool], firsts: list[bool]) -> tuple[list[int], list, list[str]]:
    """Symbols, ``[blank, duplicate, truncated, illegal, distinct turns, least, greatest turn]`` and the first and last role's initial."""
    symbols, stats, known = [], [0, 0, 0, 0], []
    edges: list[str] = []
    for turn, role, n, blank, cut, first in zip(turns, roles, copies, blanks, cuts, firsts, strict=True):
        real = n > 0 and first and not blank
        symbols.append(symbol_of(role, cut) if real else GONE)
        if not n:
            continue
        stats[0] += n if blank else 0
        stats[1] += 0 if blank else n - real
        stats[2] += real and cut
        initial = role[:1]
        stats[3] += n - 1 + (bool(edges) and edges[-1] + initial not in LEGAL)
        edges = [edges[0] if edges else initial, initial]
        if turn is not None and (not known or known[-1] != turn):
            known.append(turn)
    return symbols, [*map(int, stats), len(known), *((known[0], known[-1]) if known else (None, None))], edges


def numbered_blocks(faulty: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of conversations in order, in numbered blocks; the numbers rise along each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        conv, held, made = None, [[] for _ in range(7)], []

        def close() -> None:
            nonlocal number, held
            if held[0]:
                turns, roles, keys, copies, blanks, cuts, firsts = held
                symbols, stats, edges = summary(turns, roles, copies, blanks, cuts, firsts)
                made.append((conv, number, turns, roles, keys, copies, symbols, flat_matrix(runs_of(symbols, copies)), stats, edges))
                number += 1
                held = [[] for _ in range(7)]

        def rows() -> pa.RecordBatch:
            nonlocal made
            out, made = pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(TYPES)], NAMES), []
            return out

        for b in batches:
            columns = [column_of(b, c).to_pylist() for c in ("_t", "_r", "_d", "n", "_blank", "_cut", "_first")]
            at = 0
            for c, group in groupby(column_of(b, "_c").to_pylist()):
                end = at + len(list(group))
                if c != conv:
                    close()
                    conv = c
                while at < end:
                    stop = min(end, at + block - len(held[0]))
                    for h, column in zip(held, columns, strict=True):
                        h += column[at:stop]
                    at = stop
                    if len(held[0]) >= block:
                        close()
            if made:
                yield rows()
        close()
        if made:
            yield rows()
        give_back()

    NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
    TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    order = ["_c", "_t", "_r", "_d"]
    return faulty.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def per_conversation(rows: DataFrame, order: list[str], run, schema: str) -> DataFrame:
    """``run`` over the rows (lists of values) of each conversation in order, streamed task by task; it gives rows of the schema."""
    names = rows.columns
    fields = schema.split(", ")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [ARROW[f.split()[1]] for f in fields]
        at = names.index("_c")
        values = (r for b in batches for r in zip(*[column_of(b, c).to_pylist() for c in names], strict=True))
        made: list[tuple] = []
        for _, group in groupby(values, key=lambda r: r[at]):
            for row in run(group):
                made.append(row)
                if len(made) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], [f.split()[0] for f in fields])
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], [f.split()[0] for f in fields])

    return rows.repartition("_c").sortWithinPartitions("_c", *order).mapInArrow(stream, schema)


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def exit_costs(blocks: DataFrame) -> DataFrame:
    """Of each block the costs to go behind it, whether it is its conversation's first and last, and on the first the conversation's figures."""

    def run(group) -> Iterator[tuple]:
        group = list(group)  # a row per block, not per turn
        costs, out = END, []
        for _, number, matrix, _, _ in reversed(group):
            out.append((number, costs[:, 0].tolist()))
            costs = min_plus(np.array(matrix, np.int64).reshape(4, 4), costs)
        totals, distinct, least, greatest, before = [0, 0, 0, 0], 0, None, None, None
        for _, _, _, stats, edges in group:
            totals = [x + y for x, y in zip(totals, stats[:4], strict=True)]
            if edges:
                totals[3] += before is not None and before + edges[0] not in LEGAL
                before = edges[1]
            if stats[4]:
                distinct += stats[4] - (greatest == stats[5])
                least, greatest = stats[5] if least is None else least, stats[6]
        gaps = greatest - least + 1 - distinct if least is not None else 0
        figures = [gaps, *map(int, totals), int(costs[START, 0])]
        for k, (number, c) in enumerate(reversed(out)):
            yield group[0][0], number, c, not k, k == len(out) - 1, None if k else figures

    return per_conversation(blocks.select("_c", "_b", "_matrix", "_stats", "_edges"), ["_b"], run, "_c string, _b long, _exit array<long>, _lead boolean, _last boolean, _figures array<long>")


PATHS = "_c string, _b long, _lead boolean, _entry int, _left int, _turns array<long>, _roles array<string>, _keys array<binary>, _copies array<long>, _letters array<string>, _outs array<string>"


def paths(blocks: DataFrame, exits: DataFrame) -> DataFrame:
    """The edits of each block's rows from every state that it may be entered in, the conversation's first from none but the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, source = [[], [], [], [], []], []
            columns = [column_of(b, c).to_pylist() for c in ("_symbols", "_copies", "_exit", "_lead", "_last")]
            for k, (symbols, copies, costs, lead, last) in enumerate(zip(*columns, strict=True)):
                for entry in (START,) if lead else range(4):
                    letters, outs, left = choices(symbols, copies, costs, entry, last)
                    source.append(k)
                    for column, value in zip(made, (entry, left, letters, outs), strict=False):
                        column.append(value)
            kept = [column_of(b, c).take(pa.array(source, pa.int64())) for c in ("_c", "_b", "_lead", "_turns", "_roles", "_keys", "_copies")]
            yield pa.RecordBatch.from_arrays(
                [*kept[:3], pa.array(made[0], pa.int32()), pa.array(made[1], pa.int32()), *kept[3:], pa.array(made[2], pa.list_(pa.string())), pa.array(made[3], pa.list_(pa.string()))],
                [x.split()[0] for x in PATHS.split(", ")],
            )

    joined = blocks.drop("_c", "_matrix", "_stats", "_edges").join(exits.drop("_figures"), "_b")
    return joined.select("_c", "_b", "_turns", "_roles", "_keys", "_copies", "_symbols", "_exit", "_lead", "_last").mapInArrow(run, PATHS)


def chosen(found: DataFrame) -> DataFrame:
    """The paths that are taken: every conversation's first block's, then of each block that from the state the one before was left in."""

    def run(group) -> Iterator[tuple]:
        state = START
        for number, entries in groupby(group, key=lambda r: r[1]):
            entry, state = state, {e: left for _, _, _, e, left in entries}[state]
            yield number, entry

    # a conversation's first path is taken in any case; only those that go on in further blocks are followed
    going_on = found.filter("not _lead").select(F.col("_c").alias("_g")).distinct()
    several = found.select("_c", "_b", "_lead", "_entry", "_left").join(going_on, F.col("_c").eqNullSafe(F.col("_g")), "left_semi")
    taken = per_conversation(several, ["_b", "_entry"], run, "_b long, _entry int")
    return found.filter("_lead").unionByName(found.filter("not _lead").join(taken, ["_b", "_entry"], "left_semi"))


def edits_of(taken: DataFrame) -> DataFrame:
    """A row per row of the faults: ``_c, _t, _r, _d, _b, _i, n, _letters, _outs``."""
    zipped = F.arrays_zip("_turns", "_roles", "_keys", "_copies", "_letters", "_outs")
    rows = taken.select("_c", "_b", F.posexplode(zipped).alias("_i", "_x"))
    return rows.select("_c", F.col("_x._turns").alias("_t"), F.col("_x._roles").alias("_r"), F.col("_x._keys").alias("_d"), "_b", "_i", F.col("_x._copies").alias("n"), F.col("_x._letters").alias("_letters"), F.col("_x._outs").alias("_outs"))


def solve(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``_c, _figures`` of each conversation, and the edits of all rows."""
    blocks = shared_checkpoint(numbered_blocks(faults(rows), block))
    exits = shared_checkpoint(exit_costs(blocks))
    found = shared_checkpoint(paths(blocks, exits))
    return exits.filter("_lead").select("_c", "_figures"), edits_of(chosen(found))


def audit_of(letters: str, copies: int, gone: bool) -> str:
    """A row's letters with those of its copies, which are deleted."""
    own, _, end = letters.partition("+")
    return own + "D" * (copies if gone else copies - 1) + end.replace("+", "")


def lines_of(outs: str, role: str, text: str | None) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of what a row puts out."""
    for o in outs.replace("+", ""):
        if o == "K":
            yield "K", role, text or ""
        else:
            yield ("I" if o.islower() else "R"), ROLES[USER if o in "uU" else ASSISTANT], "" if o.islower() else text or ""


def with_texts(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits and, right behind each, the texts of its row: both in one table, to be sorted by ``_c, _t, _r, _d, _m``."""
    own = edits.select("_c", "_t", "_r", "_d", F.lit(1).alias("_m"), "_b", "_i", "n", "_letters", "_outs", F.lit(None).cast("string").alias("_text"))
    return own.unionByName(rows.filter("n > 0").select("_c", "_t", "_r", content_key().alias("_d"), F.lit(2).alias("_m"), "_text"), allowMissingColumns=True)


def repaired(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id`` (string), ``part, place, line`` (their order), ``edit`` (K, R or I), ``role, text``.

    Sorted by range over as many tasks as the texts take, whatever the conversations' sizes.
    """
    order = ["_c", "_t", "_r", "_d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            made = []
            columns = [column_of(b, c).to_pylist() for c in ("_c", "_m", "_b", "_i", "_r", "_outs", "_text")]
            for conv, m, part, place, role, outs, text in zip(*columns, strict=True):
                if m == 1:
                    waiting = (part, place, outs)
                    if outs.replace("+", "").strip("ua"):
                        continue
                if waiting is not None:
                    made += [(conv, waiting[0], waiting[1], k, *x) for k, x in enumerate(lines_of(waiting[2], role, text))]
                    waiting = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["conv_id", "part", "place", "line", "edit", "role", "text"])

    merged = with_texts(edits, rows).repartitionByRange(*order).sortWithinPartitions(*order, "_m")
    return merged.mapInArrow(run, "conv_id string, part long, place int, line int, edit string, role string, text string")


def digests(figures: DataFrame, edits: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conversation with its figures, its audit and the digest of its repaired text.

    Conversations are streamed in order; nothing is held but the audit and the digest's state.  (A digest of one text is
    sequential, so that a conversation's texts pass through one task here, and only here.)
    """

    def run(group) -> Iterator[tuple]:
        own, audit, digest, waiting, first, conv = [], [], hashlib.sha256(), None, True, None
        for conv, _, role, _, m, _, _, n, letters, outs, text, found in group:
            if m == 0:
                own = found
                continue
            if m == 1:
                waiting = outs
                audit.append(audit_of(letters, n, not letters.partition("+")[0]))
                if outs.replace("+", "").strip("ua"):
                    continue
            if waiting is not None:
                for _, r, t in lines_of(waiting, role, text):
                    digest.update(f"{'' if first else chr(10)}{r}:{t}".encode())
                    first = False
                waiting = None
        yield conv, *own, "".join(audit), digest.hexdigest()

    merged = with_texts(edits, rows).withColumn("_figures", F.lit(None).cast("array<long>"))
    heads = figures.select("_c", F.lit(0).alias("_m"), "_figures")
    merged = merged.unionByName(heads, allowMissingColumns=True).withColumn("_k", (F.col("_m") > 0).cast("int"))
    names = ["_c", "_t", "_r", "_d", "_m", "_b", "_i", "n", "_letters", "_outs", "_text", "_figures"]
    sorted_rows = merged.select(*names, "_k")
    schema = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return per_conversation(sorted_rows, ["_k", "_t", "_r", "_d", "_m"], lambda group: run(r[:-1] for r in group), schema)


def repair(conversations: DataFrame, damaged: bool = True, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults, cost, edits and repaired digest of each conversation, by default after it is damaged.

    Rows stand by turn, nulls first; those of one turn by role and then by the MD5 of their role and text, so that equal rows are
    adjacent and ties do not depend on the partitioning.  Null ids are one conversation; null roles and texts are one
    space; a conversation of which no row is left has zeros, an empty audit and the digest of the empty text; repeated rows are
    duplicates; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    make = damage if damaged else as_they_are
    rows = make(conversations, conv_col, turn_col, role_col, text_col)
    figures, edits = solve(rows, block)
    return digests(figures, edits, rows).withColumn("conv_id", F.col("conv_id").cast(conversations.schema[conv_col].dataType))
