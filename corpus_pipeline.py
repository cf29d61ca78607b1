"""A corpus-cleaning pipeline of training-data operators.

Each stage reads what its predecessor kept, whole, and its decisions take effect: toxic documents go, repeated
lines go, one document of each near-duplicate group stays, long repeated byte strings go, and what is left is
packed into sequences.  A document of which a stage leaves nothing goes with its last line or byte; one that came empty
stays.  All stages but the last return the columns of ``documents``.  Null texts count as empty, repeated rows are
documents of their own (of near duplicates, rows of one id with other texts are told apart), rows with null ids keep
their lines, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import lines, minhash, packing, suffixes, toxicity
from cinelake.llm.common import read_table, shared_checkpoint

CARRIED = ("lang", "source")


def _documents(edited: DataFrame, removed: str) -> DataFrame:
    """The columns of ``documents`` with the kept text and its length, without documents of which all was removed."""
    left = edited.filter((F.col("kept") != "") | (F.col(removed) == 0))
    return left.select("doc_id", F.col("kept").alias("text"), *CARRIED, F.char_length("kept").cast("long").alias("n_chars"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go; without labels all stay."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but for those of the least document that holds them."""
    return _documents(lines.dedup_lines(docs, carry=CARRIED), "n_dropped")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least document stays; a row goes by its id and its text."""
    gone = minhash.near_duplicates(docs, width=5, percent=80, with_key=True).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "text_key").distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("text_key")), "left_anti")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that occurs again goes, and with it what is left of a cut character."""
    return _documents(suffixes.remove_repeats(docs, length=200, carry=CARRIED, as_text=True), "n_removed")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in as few sequences as can be found; small slices, as workers of other stages are still there."""
    return packing.pack(docs, slice_bytes=2 << 20)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: Scores, signatures and tokens have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are materialised in the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = shared_checkpoint(docs)
    return docs
