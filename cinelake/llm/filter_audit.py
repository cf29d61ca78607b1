"""Filter interaction audit by truth-table survival words.

Each document becomes a 32-bit word: bit S is set where it survives the subset S of the five filters.  Carry-save adders
count how many words have each bit set, per part and label; every figure of every order of the filters follows from these
32 counts, as what survives a filter depends only on the set of filters before it.

Texts are read once.  What follows are narrow rows (a digest, an id, a part, five bits), combined before they are dealt
out, so that equal rows travel as one; the least id of each text is matched by (digest, id), which no large group of
copies shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, shared_checkpoint

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts that a task counts before it passes the counts on.
HELD_PARTS = 4096

#: The survival word of each set of failed filters: the subsets that share no filter with it.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    Three words of one weight become a sum word of that weight and a carry word of the next, all at once, until at most
    two of each weight are left.
    """
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = -(-len(words) // 3)
            x, y, z = np.concatenate([words, np.zeros(3 * third - len(words), np.uint32)]).reshape(3, third)
            odd = x ^ y
            words, carry = odd ^ z, (x & y) | (odd & z)
            carries.append(carry)
        counts += weight * (words[:, None] >> np.arange(32, dtype=np.uint32) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def weighted_popcount(words: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The same for words that stand for several equal documents each, bit by bit of the number of copies."""
    counts = np.zeros(32, np.int64)
    for bit in range(int(copies.max(initial=0)).bit_length()):
        counts += positional_popcount(words[(copies >> bit & 1).astype(bool)]) << bit
    return counts


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.char_length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def documents_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``_id, _part, _failed, copies``: the filters that documents fail; equal rows (id, text, part) are one with their number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), part.alias("_part"), F.unhex(F.sha2(text, 256)).alias("_digest"), failures(text).alias("_failed"))
    rows = shared_checkpoint(rows.groupBy("_digest", "_id", "_part", "_failed").agg(F.count("*").alias("copies")))
    first = rows.groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_least", F.lit(True))
    # a null id is neither smaller than another nor larger
    later = F.col("_least").isNull() & F.col("_id").isNotNull()
    return rows.join(first, ["_digest", "_id"], "left").select("_digest", "_id", "_part", (F.col("_failed") + F.when(later, 16).otherwise(0)).alias("_failed"), "copies")


def label_bits(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``_label``: 1 of good quality, 2 toxic, by any row of the labels; null ids have none and are spread by their text."""
    bits = F.when(F.col("quality") == 1, 1).otherwise(0), F.when(F.col("toxic") == 1, 2).otherwise(0)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_key")).agg((F.max(bits[0]) + F.max(bits[1])).alias("_label")).withColumn("_has", F.lit(True))
    keyed = rows.withColumn("_key", F.coalesce("_id", F.xxhash64("_digest"))).withColumn("_has", F.col("_id").isNotNull())
    return keyed.join(known.filter("_label > 0"), ["_key", "_has"], "left").select("_part", "_failed", "copies", F.coalesce("_label", F.lit(0)).alias("_label"))


def survivors(rows: DataFrame) -> DataFrame:
    """``part, counts``: for each subset of the filters, in order of its number, how many documents, good and toxic ones survive it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            parts, table = list(held), np.concatenate(list(held.values()), axis=1)
            subset = np.tile(np.arange(SUBSETS), len(parts))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(parts, object), SUBSETS), pa.string()), pa.array(subset, pa.int32()), *map(pa.array, table)], ["_part", "subset", "n", "good", "toxic"])

        for b in batches:
            coded = column_of(b, "_part").dictionary_encode()
            failed, copies, label = (column_of(b, c).to_numpy(zero_copy_only=False) for c in ("_failed", "copies", "_label"))
            groups = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + label
            order = np.argsort(groups, kind="stable")
            edges = np.flatnonzero(np.diff(groups[order], prepend=-1))
            for rows_of in np.split(order, edges[1:]) if len(order) else ():
                part, kind = coded.dictionary[int(groups[rows_of[0]]) // 4].as_py(), int(label[rows_of[0]])
                counts = weighted_popcount(WORDS[failed[rows_of]], copies[rows_of])
                table = held.setdefault(part, np.zeros((3, SUBSETS), np.int64))
                for k in [0, *([1] if kind & 1 else []), *([2] if kind & 2 else [])]:
                    table[k] += counts
            if len(held) > HELD_PARTS:
                yield flush()
                held = {}
        if held:
            yield flush()

    counted = rows.mapInArrow(run, "_part string, subset int, n long, good long, toxic long").groupBy("_part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return counted.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("counts")).withColumnRenamed("_part", "part")


def shapley(counts: Column, bit: int) -> Column:
    """Documents that the filter removes, summed over all orders: a set before it stands in |S|! (k - 1 - |S|)! of them."""
    k = len(FILTERS)
    terms = [(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()), s) for s in range(SUBSETS) if not s & bit]
    return sum((w * (counts[s]["n"] - counts[s | bit]["n"]) for w, s in terms), F.lit(0)).cast("long")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per part, order of the filters and step, with what that step keeps, removes and finds removed already.

    A null text is empty and a null part the empty string; repeated rows are documents of their own; a document with a
    null id is never later than another and has no labels; of several labels of a document any counts; texts of any length
    are read whole; of equal texts those of the least id pass filter E; without documents there are no rows.
    """
    counts = survivors(label_bits(documents_failures(docs, id_col, text_col, part_col), labels, id_col))
    table = F.col("counts")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.select("part", "counts", F.array(*[shapley(table, 1 << k) for k in range(len(FILTERS))]).alias("_shapley"), F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rank = lambda c: F.locate(c, F.col("filter_order"))
    mask = lambda last: sum((F.when(F.locate(c, F.col("filter_order")) <= last, 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    own = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - F.lit(ord("A"))
    steps = steps.select("*", mask(F.col("step") - 1).alias("_before"), mask(F.col("step")).alias("_after"), own.alias("_own"))
    at = lambda s, c: F.get(table, s)[c]
    bit = F.col("_after") - F.col("_before")
    lost = lambda c: at(F.col("_before"), c) - at(F.col("_after"), c)
    return steps.select(
        "part",
        "filter_order",
        "step",
        at(F.col("_after"), "n").alias("kept"),
        lost("n").alias("removed"),
        (at(F.lit(0), "n") - at(bit, "n") - lost("n")).alias("redundant"),
        (at(F.lit(SUBSETS - 1) - bit, "n") - at(F.lit(SUBSETS - 1), "n")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("_shapley", F.col("_own")).alias("shapley"),
    )


#: The same from each document's failures, counted anew for every order and step.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND len(list_distinct([f1.x, f2.x, f3.x, f4.x, f5.x])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step) u),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
