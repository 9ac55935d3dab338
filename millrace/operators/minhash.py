"""Near-duplicate detection: MinHash signatures, banded buckets, exact Jaccard of character shingles.

A record is compared with the earlier ones (by its order column) that share a bucket; the TOP best by estimate with at
least MIN_ESTIMATE are verified exactly, and a verified similarity of THRESHOLD or more makes it a near-duplicate of
the best. Exact copies (equal text after spaces collapse) are settled by their digest and aren't indexed. Null texts
count as empty; an empty text has no shingle and is unique unless copied. Ties go to the earlier record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_shingles
from ..session import cut

PERMUTATIONS, BANDS, SHINGLE = 128, 16, 5
MIN_ESTIMATE, TOP, THRESHOLD = 0.70, 5, 0.85
#: The records of a bucket are compared in parts of about so many.
PART = 500


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, PERMUTATIONS, dtype=np.uint64)


def signature(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of PERMUTATIONS hash functions over the hashes of all character shingles."""
    solid = "".join(text.split())
    cp = np.frombuffer(solid.encode("utf-32-le"), np.uint32).astype(np.uint64)
    k = min(SHINGLE, len(cp))
    if not k:
        return np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    h = np.zeros(len(cp) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ cp[j : len(cp) - k + 1 + j]) * np.uint64(0x100000001B3)
    h = np.unique(h ^ (h >> np.uint64(29)))
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(h), 4096):
        out = np.minimum(out, ((h[lo : lo + 4096, None] * a + b) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _coefficients()
    for batch in batches:
        sigs = [signature(t or "", a, b) for t in batch.column("text").to_pylist()]
        flat = np.concatenate(sigs) if sigs else np.zeros(0, np.uint32)
        col = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * PERMUTATIONS), pa.array(flat.view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("ord"), col], names=["ord", "sig"])


def bucket_pairs(bands: DataFrame, part: int = PART) -> DataFrame:
    """(ord, other), other < ord: records that share a bucket. bands: (ord, band, key). The later records of a large bucket
    are dealt into parts, each of which meets all earlier ones, so no task gets a whole bucket's pairs."""
    many = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    b = cut(bands.join(many, ["band", "key"]))
    later = b.select("band", "key", "ord", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int").alias("part"))
    earlier = b.select("band", "key", F.col("ord").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return later.join(earlier, ["band", "key", "part"]).where("other < ord").select("ord", "other").distinct()


def _bands(sigs: DataFrame) -> DataFrame:
    rows = PERMUTATIONS // BANDS
    return sigs.select("ord", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.slice("sig", i * rows + 1, rows)))).alias("band", "key"))


def signature_bands(docs: DataFrame) -> DataFrame:
    """(ord, band, key) of docs (ord, text): the bands of their signatures."""
    return _bands(docs.mapInArrow(_signatures, f"ord {dict(docs.dtypes)['ord']}, sig array<int>"))


def near_duplicates(docs: DataFrame, order: str, text: str) -> DataFrame:
    """(ord, status, duplicate_of, similarity): unique, exact_duplicate or near_duplicate of an earlier record."""
    d = docs.select(F.col(order).alias("ord"), F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ").alias("text"))
    digest = d.select("ord", F.xxhash64("text").alias("h1"), F.sha2("text", 256).alias("h2"))
    first = digest.groupBy("h1", "h2").agg(F.min("ord").alias("first"))
    status = cut(digest.join(first, ["h1", "h2"]).select("ord", "first"))
    firsts = d.join(status.where("ord = first").select("ord"), "ord", "left_semi")
    sigs = cut(firsts.where("text <> ''").mapInArrow(_signatures, f"ord {dict(d.dtypes)['ord']}, sig array<int>"))
    bands = _bands(sigs)
    pairs = bucket_pairs(bands)
    s2 = sigs.select(F.col("ord").alias("other"), F.col("sig").alias("sig2"))
    equal = F.size(F.filter(F.arrays_zip("sig", "sig2"), lambda z: z["sig"] == z["sig2"])) / PERMUTATIONS
    est = pairs.join(sigs, "ord").join(s2, "other").select("ord", "other", equal.alias("est")).where(F.col("est") >= MIN_ESTIMATE)
    w = Window.partitionBy("ord").orderBy(F.desc("est"), "other")
    top = cut(est.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP))
    t1, t2 = d.select("ord", "text"), d.select(F.col("ord").alias("other"), F.col("text").alias("text2"))
    x, y = char_shingles(F.col("text"), SHINGLE), char_shingles(F.col("text2"), SHINGLE)
    sim = top.join(t1, "ord").join(t2, "other").select("ord", "other", (F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).alias("sim"))
    best = sim.groupBy("ord").agg(F.max("sim").alias("sim"), F.min_by("other", F.struct(-F.col("sim"), "other")).alias("other"))
    out = status.join(best, "ord", "left")
    near = F.col("sim") >= THRESHOLD
    return out.select(
        "ord",
        F.when(F.col("ord") != F.col("first"), "exact_duplicate").when(near, "near_duplicate").otherwise("unique").alias("status"),
        F.when(F.col("ord") != F.col("first"), F.col("first")).when(near, F.col("other")).alias("duplicate_of"),
        F.when(F.col("ord") != F.col("first"), F.lit(1.0)).otherwise(F.round(F.coalesce("sim", F.lit(0.0)), 4)).alias("similarity"),
    )
