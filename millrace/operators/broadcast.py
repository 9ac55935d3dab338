"""Broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its counted rows and their bytes stay within these bounds; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        fixed = not isinstance(kind, T.MapType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType))
        return F.when(c.isNull(), 0).otherwise(F.size(c)) * 8 + 16 if fixed else F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 16
    return F.lit(8)


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that its join shuffles. Spark takes the rows of an exploded side for those before the explosion, so it
    would broadcast sides many times the threshold."""
    return df.hint("merge")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes are within the bounds, else df. df should be cut before."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))
    n, b = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= most else df
