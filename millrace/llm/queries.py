"""The training-data queries: pN_... of problem N, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from . import abuse, furniture, langid, leaks, ocr, overlap, packing, pii, quality, splits


def _build(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "build")


def _frequent(build: DataFrame) -> DataFrame:
    return furniture.frequent_lines(furniture.line_sequences(build))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    return quality.not_prose(b, _frequent(b))


def p1_statistics(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    return quality.statistics(b, _frequent(b)).distinct()


def p2_found(s: SparkSession, d: str) -> DataFrame:
    rec = furniture.line_sequences(_build(s, d))
    return furniture.occurrences(rec, furniture.sequence_lines(rec, furniture.frequent_lines(rec)))


def p2_sequences(s: SparkSession, d: str) -> DataFrame:
    rec = furniture.line_sequences(_build(s, d))
    spans = furniture.prefix_span(rec, furniture.frequent_lines(rec))
    return spans.groupBy("src", F.size("pattern").alias("n_lines")).agg(F.count("*").alias("n_sequences"), F.max("n_records").alias("most_records"))


def p2_cleaned(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    rec = furniture.line_sequences(b)
    return furniture.remove(b, furniture.sequence_lines(rec, furniture.frequent_lines(rec))).where("uid is not null").distinct()


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return splits.found(_build(s, d), table(s, d, "health_gates_and_support"))


def p3_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.assign(_build(s, d), table(s, d, "health_gates_and_support"))


def p3_report(s: SparkSession, d: str) -> DataFrame:
    return splits.report(_build(s, d), table(s, d, "health_gates_and_support"))


def p3_checks(s: SparkSession, d: str) -> DataFrame:
    return splits.checks(_build(s, d), table(s, d, "health_gates_and_support"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    return overlap.found(b, table(s, d, "split_manifest"), _frequent(b))


def p4_report(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    return overlap.report(b, table(s, d, "split_manifest"), _frequent(b))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return pii.found(_build(s, d), table(s, d, "name_parts"))


def p5_masked(s: SparkSession, d: str) -> DataFrame:
    m = pii.mask(_build(s, d), table(s, d, "name_parts"))
    return m.select("uid", "text", F.coalesce(F.aggregate(F.map_values("pii_masked"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("n_masked")).where("uid is not null").distinct()


def p5_report(s: SparkSession, d: str) -> DataFrame:
    return pii.report(_build(s, d), table(s, d, "name_parts"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return ocr.found(_build(s, d), table(s, d, "name_parts"))


def p6_repaired(s: SparkSession, d: str) -> DataFrame:
    return ocr.repair(_build(s, d), table(s, d, "name_parts"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    return langid.found(b, _frequent(b), table(s, d, "name_parts"))


def p7_segments(s: SparkSession, d: str) -> DataFrame:
    b = _build(s, d)
    f = _frequent(b)
    return langid.segments(b, f, table(s, d, "name_parts"), langid.train(b, f)).distinct()


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return packing.found(table(s, d, "documents", "doc_id", "text"), table(s, d, "containers"))


def p8_packing(s: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(table(s, d, "documents", "doc_id", "text"), table(s, d, "containers"))


def p8_report(s: SparkSession, d: str) -> DataFrame:
    return packing.report(table(s, d, "documents", "doc_id", "text"), table(s, d, "containers"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(s, d, "documents", "doc_id", "text"), table(s, d, "eval_items"))


def p9_items(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "eval_items", "item_id", "suite").distinct()
    n = p9_found(s, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return abuse.found(table(s, d, "documents"), table(s, d, "content_labels"), table(s, d, "abuse_terms"))


def p10_scores(s: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(s, d, "documents"), table(s, d, "content_labels"), table(s, d, "abuse_terms"))


def p10_rates(s: SparkSession, d: str) -> DataFrame:
    return abuse.report(table(s, d, "documents"), table(s, d, "content_labels"), table(s, d, "abuse_terms"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_statistics, p2_found, p2_sequences, p2_cleaned, p3_found, p3_splits, p3_report, p3_checks, p4_found, p4_report, p5_found, p5_masked, p5_report,
        p6_found, p6_repaired, p7_found, p7_segments, p8_found, p8_packing, p8_report, p9_found, p9_items, p10_found, p10_scores, p10_rates,
    )
}
