"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], by: str, rank: str = "rank", buckets: int = 1024) -> DataFrame:
    """df with the 0-based rank of each row in its group, in the order of the hash of column by (ties by its value).

    No task holds a whole group: rows are ranked within buckets of the hash, and the buckets' counts, a small table,
    give each bucket's offset. Rows with equal by-values share an arbitrary order, so by should be unique.
    """
    h = df.withColumn("_h", F.xxhash64(by)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    keys = [*group, "_b"]
    offsets = h.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", by))
    return h.withColumn("_r", inside).join(offsets, keys).withColumn(rank, F.col("_o") + F.col("_r") - 1).drop("_h", "_b", "_r", "_o")
