"""Conversation repair against an exhaustive search over all edits of small conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from cinelake.llm import conversations as cv
from cinelake.llm import registry

SPACE = re.compile(r"[\x20\x09-\x0D]")
ZERO = ("", hashlib.sha256(b"").hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def in_order(rows):
    content = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], content(r)))


def fault(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        stripped = SPACE.sub("", text)
        kind = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def short(initials):
    """The same initials with fewer whole pairs, which do not matter for what may follow."""
    return re.sub("^(s?)(ua)+(u?)$", r"\1ua\3", initials)


def search(rows, faults):
    """The least (cost, audit) and its lines, over every edit of every row with up to two insertions before each."""

    @lru_cache(None)
    def rest(i, inserted, initials):
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return None
        found = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            fee = faults[i] == "truncated"
            options = [(3, "D", "", ())]
            if faults[i] not in ("blank", "duplicate"):
                options.append((fee, "K", role[:1] or "-", (f"{role}:{text}",)))
                options += [(2 + fee, "R", r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
            found += [(cost, letter, lines, rest(i + 1, 0, short(initials + initial))) for cost, letter, initial, lines in options]
        if inserted < 2:
            found += [(2, "I", (f"{r}:",), rest(i, inserted + 1, short(initials + r[0]))) for r in ("user", "assistant")]
        whole = [f if len(f) == 3 else (f[0] + f[3][0], f[1] + f[3][1], f[2] + f[3][2]) for f in found if len(f) == 3 or f[3]]
        return min(whole, default=None)

    return rest(0, 0, "")


def expected(rows):
    rows = in_order(rows)
    kinds = fault(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit, lines = search(rows, kinds)
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for k in range(rnd.randint(0, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rnd.choice([k, k, k, None, rnd.randint(0, 9)]), role, rnd.choice(["Yes.", "No!\n", "why", " \t", "", None, "é?", f"text {k}."])))
    return rows


def got(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("block", [1, 3, cv.BLOCK])
def test_repair_equals_exhaustive_search(spark, block):
    rows = random_rows(7, 60, 6)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _c string, n int")
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    want = {c: expected(by[c]) for c in {r[0] for r in rows}}
    assert got(cv.repair(frame, block=block)) == want
    assert any(w[5] > 6 for w in want.values()) and any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_undamaged_and_repaired_turns(spark):
    rows = random_rows(11, 40, 5)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = cv.as_they_are(frame)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((c, t, " " if r is None else r, " " if x is None else x))
    want = {c: expected(v) for c, v in by.items()}
    assert got(cv.repair(frame, damaged=False, block=2)) == want
    _, edits = cv.solve(plain, 2)
    lines = defaultdict(list)
    for r in sorted(cv.repaired(edits, plain).collect(), key=lambda r: (r.part, r.place, r.line)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for c, v in want.items():
        assert hashlib.sha256("\n".join(lines[None if c is None else str(c)]).encode()).hexdigest() == v[7]


def test_long_runs_and_hot_conversation(spark):
    """One conversation of many equal and unequal turns, in blocks, equals the same in one block."""
    rnd = random.Random(3)
    roles = [r for _ in range(60) for r in [rnd.choice(["user", "assistant", "system", "tool"])] * rnd.choice([1, 1, 2, 40, 100])]
    frame = spark.createDataFrame([(1, k, r, f"turn {k}" + rnd.choice(["", ".", "?"])) for k, r in enumerate(roles)] + [(2, 5, "user", "same.")] * 500, "conv_id long, turn long, role string, text string")
    whole, cut = got(cv.repair(frame, damaged=False)), got(cv.repair(frame, damaged=False, block=37))
    assert whole == cut
    assert whole[2][2] == 499 and whole[2][6].count("D") >= 499
    lines = replay(roles, whole[1][6])
    assert re.fullmatch("(s?(ua)+)?", lines)


def replay(roles, audit):
    out, at = "", 0
    for letter in audit:
        due = "a" if out.endswith("u") else "u"
        if letter == "K":
            out += roles[at][0]
        elif letter in "RI":
            out += due
        at += letter != "I"
    return out


def test_run_powers_equal_single_steps():
    rnd = random.Random(5)
    for _ in range(50):
        symbols = [s for _ in range(6) for s in [rnd.randrange(9)] * rnd.choice([1, 2, 7])]
        single = np.full((4, 4), cv.FAR)
        single[range(4), range(4)] = 0
        for s in reversed(symbols):
            single = cv.min_plus(cv.step(s), single)
        runs = cv.matrix_of(cv.runs_of(symbols, [1] * len(symbols)))
        assert np.array_equal(cv.min_plus(single, cv.END), cv.min_plus(runs, cv.END))
        stack = cv.all_costs(symbols[0] or 1, 9, cv.END)
        for k in range(10):
            assert np.array_equal(stack[k], cv.advance(symbols[0] or 1, k, cv.END)[:, 0])


def test_empty_dropped_and_registered(spark, tmp_path):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair(frame).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(5, dropped, "user", "Hm.")], "conv_id long, turn long, role string, text string")
    assert got(cv.repair(frame)) == {5: (0, 0, 0, 0, 0, 0, *ZERO)}
    long = "word " * 400_000 + "end."
    frame = spark.createDataFrame([("a", 1, "user", long), ("a", 2, "assistant", long)], "conv_id string, turn int, role string, text string")
    r = cv.repair(frame, damaged=False).collect()[0]
    assert r.conv_id == "a" and r.audit == "KK" and r.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert "op13_conversation_repair" in registry.queries()


def test_query_on_given_table(spark):
    d = "/root/testdata/sf0.001"
    out = got(registry.op13_conversation_repair(spark, d))
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    assert out == {c: expected(by[c]) for c in {r[0] for r in rows}}
