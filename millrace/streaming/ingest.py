"""Incremental ingestion with Structured Streaming: resumable scans, append-only output, deduplicated merges.

A run processes what is new since its checkpoint and stops; run again it does only the rest. Outputs are written per
micro-batch under the batch's number, so a repeated batch replaces its own output and nothing is doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, kind: str = "parquet", files_per_batch: int | None = None) -> int:
    """Files of a folder that no earlier run saw, transformed and appended to target; gives the rows written."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = [0]

    def write(batch: DataFrame, number: int) -> None:
        path = f"{target}/batch={number}"
        transform(batch).write.mode("overwrite").parquet(path)
        rows[0] += spark.read.parquet(path).count()

    reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows[0]


def merge_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, kind: str = "parquet") -> None:
    """Like ingest, but rows whose key earlier batches wrote are skipped, and a batch keeps one row per key (the least
    by all its columns). Numbers of earlier batches only are read, so repeating a batch gives the same result."""

    def write(batch: DataFrame, number: int) -> None:
        fields = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.min(F.struct(*fields)).alias("r")).select(key, "r.*")
        try:
            seen = spark.read.parquet(target).where(F.col("batch") < number).select(key).distinct()
            one = one.join(seen, key, "left_anti")
        except Exception as e:  # the target doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        one.write.mode("overwrite").parquet(f"{target}/batch={number}")

    spark.readStream.format(kind).schema(schema).load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums per window and type, for batches and streams alike; a stream drops what is later than the
    watermark. An addition: no window is derived from the corpus tools."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
