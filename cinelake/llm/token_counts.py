"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram answer totals, quantiles and truncated
totals for every context limit.  The histogram is written once, so that texts are encoded once, and cut in blocks of
lengths, so that no window spans all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec
from .common import column_of, id_text, shared_checkpoint, slices

BLOCK = 1024


def lengths(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of each row; a null or empty text has no tokens.

    Repeated rows are counted each on its own; a null id stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in slices(batches, max_bytes=8 << 20):
            _, offsets = c.encode_column(column_of(b, "_text"))
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: totals of the documents at least, and at most, as long.

    ``n_docs``: documents of this length; ``docs_at_least``, ``tokens_at_least``: with this length or more;
    ``truncated_total``: tokens left if every document is cut to this length; ``share_at_most``: share of the
    documents that fit.  Ids play no part, so that repeated rows count each and null ids count too.  An empty table
    gives no rows.
    """
    hist = shared_checkpoint(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("_b", F.expr(f"n_tokens div {BLOCK}"))
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    # one row per BLOCK lengths: the longest document bounds their number
    above = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("_b", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_da"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_ta"), F.sum("_d").over(whole).alias("_n"), F.sum("_t").over(whole).alias("_all"))
    inner = W.partitionBy("_b").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = hist.join(blocks, "_b")
    out = out.withColumn("docs_at_least", F.col("_da") + F.sum("n_docs").over(inner)).withColumn("tokens_at_least", F.col("_ta") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("_n") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_n")).alias("share_at_most"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of the documents does not exceed."""
    return hist.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit, docs_over, docs_within, total`` for each of the ``limits``, whether or not a document has this length.

    Documents that are cut and that fit, and the tokens left if every document is cut to the limit: suffix sums over
    blocks of lengths, and the longer lengths of the limit's own block.  Null limits are dropped; a repeated limit is
    answered once; an empty histogram has no documents and no tokens.
    """
    block = lambda c: F.expr(f"`{c}` div {BLOCK}")
    wanted = limits.select(F.col("limit").cast("long").alias("limit")).dropna().distinct().withColumn("_b", block("limit"))
    lengths = hist.select("n_tokens", F.col("n_docs").alias("_d"), (F.col("n_docs") * F.col("n_tokens")).alias("_t"), block("n_tokens").alias("_b"))
    blocks = lengths.select("_b", "_d", "_t").unionByName(wanted.select("_b", F.lit(0).alias("_d"), F.lit(0).alias("_t"))).groupBy("_b").agg(F.sum("_d").alias("_d"), F.sum("_t").alias("_t"))
    above = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("_d", above, "_da"), ("_t", above, "_ta"), ("_d", whole, "_n"), ("_t", whole, "_all"))]
    near = wanted.join(blocks.select(F.col("_b"), *sums), "_b").join(lengths.withColumnRenamed("_b", "_lb"), (F.col("_b") == F.col("_lb")) & (F.col("n_tokens") > F.col("limit")), "left")
    over = near.groupBy("limit", "_da", "_ta", "_n", "_all").agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("_do"), F.coalesce(F.sum("_t"), F.lit(0)).alias("_to"))
    docs, tokens = F.col("_da") + F.col("_do"), F.col("_ta") + F.col("_to")
    return over.select("limit", docs.alias("docs_over"), (F.col("_n") - docs).alias("docs_within"), (F.col("_all") - tokens + F.col("limit") * docs).alias("total"))
