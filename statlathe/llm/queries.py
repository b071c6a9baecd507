"""The registered queries of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlathe.llm import canon, copies, leaks, lookalike, mixture, mojibake, names, overlap, splits

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return splits.group_related(_table(spark, folder, "statements"), "row_id", "speaker_name", "norm_key")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder).where("n_rows > 1").select("row_id", "group_row_id")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(_groups(spark, folder), SHARES)


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_report(p1_splits(spark, folder), SHARES)


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.find_garbled(_table(spark, folder, "statements"), "row_id", ["statement", "statement_clean"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_restored(spark, folder).select("row_id", "field_name")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return names.cluster_names(_table(spark, folder, "statements"), "speaker_name", "speaker_job")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(p3_clusters(spark, folder))


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return copies.record_groups(_table(spark, folder, "statements"), "row_id", ["statement", "speaker_name"], "subjects")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).where("row_id != first_row_id").select("first_row_id", "row_id")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapse(_table(spark, folder, "statements"), "row_id", ["statement", "speaker_name"], "subjects")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(_table(spark, folder, "statements"), "row_id", "statement", "split_name")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, folder, "statements"), "row_id", "statement", "split_name", "feed")


FIELDS = ["speaker_affiliation", "statement_context"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return canon.map_fields(_table(spark, folder, "statements"), "row_id", FIELDS, _table(spark, folder, "canon_values"))


def p6_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return canon.unmatched(_table(spark, folder, "statements"), FIELDS, _table(spark, folder, "canon_values"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    index = leaks.build_index(_table(spark, folder, "documents"), "doc_id", "text")
    return leaks.search(index, _table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_passages(spark, folder).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(_table(spark, folder, "documents"), "doc_id", "text", "source", _table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix_report(p9_mix(spark, folder), "source", _table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.look_pairs(_table(spark, folder, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.canonical(_table(spark, folder, "documents"), "doc_id", "text")


def p10_groups(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.look_groups(_table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    every = [
        p1_found, p1_splits, p1_report, p2_found, p2_restored, p3_found, p3_clusters, p4_found, p4_records, p5_found, p5_report,
        p6_found, p6_unmatched, p8_found, p8_passages, p9_mix, p9_shares, p10_found, p10_canonical, p10_groups,
    ]
    return {q.__name__: q for q in every}
