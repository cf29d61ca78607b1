"""The contract queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, filter_audit, imatch, licenses, lines, minhash, packing, quality, suffixes, token_counts, toxicity, windows
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup_lines(read_table(spark, sf_dir, "documents")))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_pairs(read_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(read_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(read_table(spark, sf_dir, "documents")))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_windows(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_bpe_codec,
            op2_best_fit_packing,
            op3_line_dedup,
            op4_imatch_fingerprints,
            op5_minhash_near_dedup,
            op6_token_counts,
            op7_toxicity,
            op8_quality_rules,
            op9_license_scan,
            op10_suffix_array_dedup,
            op11_window_packing,
            op12_filter_audit,
            op13_conversation_repair,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.ORACLE_SQL, "op5_minhash_near_dedup": minhash.ORACLE_SQL, "op9_license_scan": licenses.oracle_sql(), "op10_suffix_array_dedup": suffixes.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
