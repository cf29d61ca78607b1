"""Hashes of 64 bits within a Hamming distance, by keys that such pairs must share.

A hash is cut in ``pieces``.  Two hashes that differ in at most ``radius`` bits differ in at most as many pieces, so that they agree in some
choice of the others.  Each choice of ``pieces - radius`` pieces is a key; hashes meet where they share one, and are compared
in full there.  Equal hashes are one, so that a group of copies of any size meets once.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most keys that a hash is dealt out under, and bits that make a key selective enough; of a short hash, half of its bits are.
MOST_KEYS, SELECTIVE = 200, 30


def pieces_for(radius: int, bits: int = 64) -> int:
    """The least number of pieces that makes keys selective, or else the most pieces that the number of keys allows.

    Beyond a radius of four bits, and in hashes of less than 60 bits, keys hold fewer bits, and more hashes meet under each.
    """
    allowed = [p for p in range(radius + 1, bits + 1) if comb(p, radius) <= MOST_KEYS]
    return next((p for p in allowed if bits * (p - radius) >= min(SELECTIVE, bits / 2) * p), allowed[-1])


def widths(pieces: int, bits: int = 64) -> list[tuple[int, int]]:
    """First bit and length of each piece."""
    edges = [bits * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def piece(h: Column, first: int, length: int) -> Column:
    return h if length == 64 else F.shiftright(h, first).bitwiseAND(F.lit((1 << length) - 1))


def classes(hashes: DataFrame, key: str = "frame_no", value: str = "hash") -> DataFrame:
    """``key, hash, class``: the least key with the same hash; rows without a hash are left out."""
    known = hashes.select(F.col(key).alias("key"), F.col(value).cast("long").alias("hash")).filter("hash is not null")
    return known.join(known.groupBy("hash").agg(F.min("key").alias("class")), "hash").select("key", "hash", "class")


def neighbours(hashes: DataFrame, radius: int, key: str = "frame_no", value: str = "hash", pieces: int | None = None, bits: int = 64) -> DataFrame:
    """``a, b, distance`` of all pairs of different hashes within the radius; ``a`` and ``b`` are the least keys of each hash, a < b.

    With ``classes`` these give all pairs of rows, which need not be made.  Hashes differ in their lowest ``bits`` only: all
    of them would meet under a key of bits that are the same throughout.
    """
    if not 0 <= radius < 16:
        raise ValueError("the radius is from 0 to 15")
    if not radius < bits <= 64:
        raise ValueError("hashes have more bits than the radius, and 64 at most")
    pieces = min(pieces, bits) if pieces is not None else pieces_for(radius, bits)
    spans = widths(pieces, bits)
    choices = list(combinations(range(pieces), pieces - radius))
    distinct = hashes.select(F.col(key).alias("_key"), F.col(value).cast("long").alias("_hash")).filter("_hash is not null").groupBy("_hash").agg(F.min("_key").alias("_key"))
    masks = [sum(((1 << n) - 1) << k for k, n in (spans[i] for i in c)) for c in choices]
    rows = spread(distinct, "_hash").select("_key", "_hash", F.posexplode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("_n", "_m"))
    rows = rows.select("_key", "_hash", "_n", F.col("_hash").bitwiseAND(F.col("_m")).alias("_h"))
    # both sides are the same rows, dealt once
    left = rows.select("_n", "_h", F.col("_key").alias("a"), F.col("_hash").alias("_x"))
    right = rows.select("_n", "_h", F.col("_key").alias("b"), F.col("_hash").alias("_y"))
    differing = F.col("_x").bitwiseXOR(F.col("_y"))
    # a pair may share several keys: the first of them gives it, before whose last piece all others differ.  A piece differs where
    # its lower bits, added to as many ones, or its own highest bit set its highest bit; the last piece of all is never asked for
    lower = sum(((1 << n - 1) - 1) << k for k, n in spans[:-1])
    highest = [sum(1 << k + n - 1 for k, n in (spans[i] for i in range(c[-1]) if i not in c)) if c else 0 for c in choices]
    others = F.get(F.array(*[F.lit(h).cast("long") for h in highest]), F.col("_n"))
    differ = (differing.bitwiseAND(F.lit(lower).cast("long")) + F.lit(lower).cast("long")).bitwiseOR(differing)
    met = met_under(left, right).filter((F.bit_count(differing) <= radius) & (F.col("a") < F.col("b")))
    return met.filter(differ.bitwiseAND(others) == others).select("a", "b", F.bit_count(differing).alias("distance"))


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows that become many each, in as many partitions as a shuffle has: adaptive execution would join them up by the bytes of the few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by))


def met_under(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that share a key, by sorting, what differs most first.  Spark takes dealt rows for as many bytes as what they were made of, and would broadcast them."""
    return left.hint("merge").join(right.hint("merge"), ["_h", "_n"])


def _signed(mask: int) -> int:
    """Sixty-four bits as a long."""
    return mask - (1 << 64) if mask >> 63 else mask


def nearest(hashes: DataFrame, asked: DataFrame, radius: int, key: str = "frame_no", value: str = "hash", bits: int = 64) -> DataFrame:
    """For each row of ``asked`` (``key``, ``hash``) the rows within the radius: ``asked, found, distance``."""
    pieces = pieces_for(radius, bits)
    spans, choices = widths(pieces, bits), list(combinations(range(pieces), pieces - radius))

    def keyed(rows: DataFrame, own: str, hashed: str) -> DataFrame:
        known = rows.select(F.col(key).alias(own), F.col(value).cast("long").alias(hashed)).filter(F.col(hashed).isNotNull())
        each = known.withColumn("_p", F.array(*[piece(F.col(hashed), *s) for s in spans]))
        keys = F.array(*[F.struct(F.lit(n).alias("_n"), F.xxhash64(*[F.get("_p", F.lit(k)) for k in c]).alias("_h")) for n, c in enumerate(choices)])
        return each.select(own, hashed, F.inline(keys))

    met = met_under(keyed(asked, "asked", "_x"), keyed(hashes, "found", "_y"))
    distance = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y")))
    return met.filter(distance <= radius).select("asked", "found", distance.alias("distance")).distinct()
