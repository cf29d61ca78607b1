"""Gaps and islands over ordered rows, and other window helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Places that are searched for runs together.
BLOCK = 65536


def islands(rows: DataFrame, key: list[str], at: str, inside: Column, least: int, drop_trailing: bool = False, block: int = BLOCK) -> DataFrame:
    """Half-open runs ``[start, stop)`` of consecutive rows (``at`` counts up by one) with ``inside``, ``least`` rows long.

    With ``drop_trailing`` a run that reaches the end of its key is left out.  Runs are found within blocks of places, so that a
    long stream is spread over many tasks; only runs, and no rows, meet per key, where those that touch are joined.
    """
    marked = rows.withColumn("_in", inside)
    within = W.partitionBy(*key, "_b").orderBy(at)
    parts = marked.filter("_in").withColumn("_b", F.floor(F.col(at) / block)).withColumn("_g", F.col(at) - F.row_number().over(within))
    parts = parts.groupBy(*key, "_b", "_g").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop"))
    order = W.partitionBy(*key).orderBy("start")
    apart = F.coalesce(F.lag("stop").over(order) != F.col("start"), F.lit(True))
    runs = parts.withColumn("_new", apart.cast("long")).withColumn("_r", F.sum("_new").over(order))
    out = runs.groupBy(*key, "_r").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).filter(F.col("stop") - F.col("start") >= least)
    if drop_trailing:
        ends = marked.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)]).agg(F.max(at).alias("_end"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(key)]
        out = out.join(ends, same).filter(F.col("stop") <= F.col("_end"))
    return out.select(*key, "start", "stop")


def trailing(key: list[str], at: str, n: int) -> W:
    """The window of the current row and the n - 1 rows before it."""
    return W.partitionBy(*key).orderBy(at).rowsBetween(1 - n, 0)


def centered(key: list[str], at: str, n: int) -> W:
    """The window of n // 2 rows on both sides, cut at the ends."""
    return W.partitionBy(*key).orderBy(at).rowsBetween(-(n // 2), n // 2)


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, inclusive: bool = True) -> DataFrame:
    """Each left row with the last right row at or before it, by one sort of both sides (no pairs are made)."""
    both = left.select(key, at, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[at].dataType).alias("_at"))
    other = right.select(key, at, F.lit(0 if inclusive else 2).alias("_side"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.col(at).alias("_at"))
    seen = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = both.unionByName(other).withColumn("_m", F.last("_at", ignorenulls=True).over(seen)).withColumn("_w", F.last("_v", ignorenulls=True).over(seen))
    return filled.filter("_side = 1").select("_l.*", F.col("_m").alias(f"right_{at}"), F.col("_w").alias(f"right_{value}"))


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, stop: str, width: int, closed: bool = False) -> DataFrame:
    """Points with the spans that hold them: equi-join on buckets ``width`` wide, then the exact test.

    A span is repeated once for each bucket that it reaches, a point once, so that no all-pairs join is run.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    last = F.col(stop) if closed else F.greatest(F.col(stop) - 1, F.col(start))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    joined = p.join(s, [key, "_bucket"])
    upper = F.col(at) <= F.col(stop) if closed else F.col(at) < F.col(stop)
    return joined.filter((F.col(at) >= F.col(start)) & upper).drop("_bucket")


def near_join(a: DataFrame, b: DataFrame, key: str, at: str, tolerance: int) -> DataFrame:
    """Pairs with the same key whose places differ by at most ``tolerance``; ``b``'s place is named ``other``."""
    left = a.withColumn("_bucket", F.explode(F.expr(f"sequence(floor({at} / {tolerance + 1}) - 1, floor({at} / {tolerance + 1}) + 1)")))
    right = b.select(key, F.col(at).alias("other"), F.floor(F.col(at) / (tolerance + 1)).alias("_bucket"))
    return left.join(right, [key, "_bucket"]).filter(F.abs(F.col(at) - F.col("other")) <= tolerance).drop("_bucket")
