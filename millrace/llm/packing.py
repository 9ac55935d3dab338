"""Filling fixed-capacity containers: pattern packing by non-negative least squares.

A document's size is one token per UTF-8 byte and one end token. Only a document larger than the capacity is cut, into
full pieces and a rest; the rest is packed like any item. The histogram of sizes has at most as many entries as the
capacity, whatever the corpus, so patterns (a few sizes that fill a container) are enumerated and fitted on the driver:
repeat counts x >= 0 minimise |A x - histogram|; they are rounded down within what is left, and the residual is packed
by best fit over the histogram. Each size's patterns become ranges of ranks; documents are ranked within their size
without gathering a size in one task, and look their container up in those ranges.

Null and empty texts have no size and are not packed; a null doc_id is left out; repeated rows are packed as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import ranked

END_TOKENS = 1
#: A pattern has at most so many documents.
FEW = 8


def items(documents: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity_tokens, doc_id, tokens, pieces, size): per capacity what is left to pack of each document, and how many
    containers it touches. The texts are read once for all capacities."""
    d = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", (F.octet_length("text") + END_TOKENS).cast("bigint").alias("tokens"))
    d = d.withColumn("capacity_tokens", F.explode(F.array(*(F.lit(c).cast("bigint") for c in capacities))))
    capacity, rest = F.col("capacity_tokens"), F.expr("tokens % capacity_tokens")
    size = F.when((F.col("tokens") > capacity) | (rest == 0), rest).otherwise(F.col("tokens"))
    return d.select("capacity_tokens", "doc_id", "tokens", F.ceil(F.col("tokens") / capacity).cast("bigint").alias("pieces"), size.cast("bigint").alias("size"))


def patterns(sizes: np.ndarray, capacity: int, tries: int = 6, seed: int = 7) -> list[tuple[int, ...]]:
    """Indices into sizes (ascending) of combinations of at most FEW that fill a container well: each starts with one
    size, goes on with random ones and ends with the size that fits best. Those that FEW sizes leave unfilled by more than
    the least size are left to the packing of the rest."""
    rng = np.random.default_rng(seed)
    out = set()
    for i in range(len(sizes)):
        for t in range(tries):
            left, p = capacity - int(sizes[i]), [i]
            while left >= sizes[0] and len(p) <= FEW:
                top = int(np.searchsorted(sizes, left, "right")) - 1
                closing = left <= 2 * sizes[0] or len(p) >= 1 + t or sizes[top] == left
                j = top if closing else int(rng.integers(0, top + 1))
                p.append(j)
                left -= int(sizes[j])
            if len(p) <= FEW:
                out.add(tuple(sorted(p)))
    return sorted(out)


def fit(pats: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares for A x = counts by accelerated projected gradient; column p of A counts the sizes of
    pattern p."""
    p = np.repeat(np.arange(len(pats)), [len(x) for x in pats])
    i = np.concatenate([np.array(x) for x in pats])
    mul = lambda x: np.bincount(i, x[p], len(counts))
    back = lambda r: np.bincount(p, r[i], len(pats))
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(mul(v))
        v /= np.linalg.norm(v)
    step = 1 / max(1e-9, float(np.linalg.norm(back(mul(v)))) * 1.02)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(mul(y) - counts))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every item once. sizes ascending, counts > 0."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(p: tuple[int, ...], n: int) -> None:
        for j in p:
            left[j] -= n
        out.append((p, n))

    def room(p: tuple[int, ...]) -> int:
        k, m = np.unique(p, return_counts=True)
        return int((left[k] // m).min())

    if len(sizes):
        pats = patterns(sizes, capacity)
        x = fit(pats, counts.astype(float)) if pats else np.zeros(0)
        fill = np.array([sum(int(sizes[j]) for j in p) for p in pats])
        for k in np.lexsort((-x, -fill)):
            n = min(int(x[k]), room(pats[k]))
            if n > 0:
                use(pats[k], n)
    while left.any():
        have = np.flatnonzero(left)
        p, free, spare = [], capacity, left.copy()
        while True:
            fits = have[(spare[have] > 0) & (sizes[have] <= free)]
            if not len(fits):
                break
            p.append(int(fits[-1]))
            spare[p[-1]] -= 1
            free -= int(sizes[p[-1]])
        use(tuple(p), max(1, room(tuple(p))))
    return out


def ranges(sizes: np.ndarray, made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per size (sorted): from which rank on an item goes to which container on; arrays of (size, first rank, first container)."""
    at, base, rows = np.zeros(len(sizes), np.int64), 0, []
    for p, n in made:
        for j in p:
            rows.append((int(sizes[j]), int(at[j]), base))
            at[j] += n
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def look_up(sizes: np.ndarray, planned: tuple[np.ndarray, np.ndarray, np.ndarray], size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The containers of items, given their sizes and ranks within their size."""
    s, lo, box = planned
    first = np.searchsorted(s, sizes)
    start = np.append(first, len(s))[np.searchsorted(sizes, size)]
    out = np.empty(len(size), np.int64)
    # Per size the ranges ascend, so items sorted by size and rank meet them in order.
    order = np.lexsort((rank, size))
    k = start[order]
    end = np.searchsorted(s, size[order], "right")
    step = 1 << max(0, int((end - k).max() if len(k) else 0).bit_length() - 1)
    while step:
        nxt = k + step
        ok = (nxt < end) & (lo[np.minimum(nxt, len(lo) - 1)] <= rank[order])
        k = np.where(ok, nxt, k)
        step >>= 1
    out[order] = box[k] + rank[order] - lo[k]
    return out


PACKED = "capacity_tokens bigint, doc_id bigint, tokens bigint, pieces bigint, container bigint"


def pack_all(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(capacity_tokens, doc_id, tokens, pieces, container) for every capacity of containers (a fixed, small table): the
    container of each document, or of its rest. A larger document also fills containers of its own with its full pieces;
    container is null if it leaves no rest."""
    spark = documents.sparkSession
    capacities = sorted(int(r["capacity_tokens"]) for r in containers.select("capacity_tokens").where("capacity_tokens > 0").distinct().collect())
    if not capacities:
        return spark.createDataFrame([], PACKED)
    it = cut(items(documents, capacities))
    # At most `capacity` entries per capacity.
    hist: dict[int, list[tuple[int, int]]] = {c: [] for c in capacities}
    for r in it.where("size > 0").groupBy("capacity_tokens", "size").agg(F.count("*").alias("n")).orderBy("capacity_tokens", "size").collect():
        hist[r["capacity_tokens"]].append((r["size"], r["n"]))
    plans = {}
    for c, h in hist.items():
        sizes, counts = np.array([x for x, _ in h], np.int64), np.array([n for _, n in h], np.int64)
        plans[c] = (sizes, ranges(sizes, plan(sizes, counts, c)))
    where = spark.sparkContext.broadcast(plans)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cap, size, rank = (np.asarray(b.column(x), np.int64) for x in ("capacity_tokens", "size", "rank"))
            box = np.zeros(b.num_rows, np.int64)
            for c in np.unique(cap).tolist():
                i = np.flatnonzero(cap == c)
                sizes, planned = where.value[c]
                box[i] = look_up(sizes, planned, size[i], rank[i])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("capacity_tokens", "doc_id", "tokens", "pieces")), pa.array(box)], names=[x.split()[0] for x in PACKED.split(", ")])

    packed = ranked(it.where("size > 0"), ["capacity_tokens", "size"], "doc_id").select("capacity_tokens", "doc_id", "tokens", "pieces", "size", "rank").mapInArrow(look, PACKED)
    full = it.where("size = 0").select("capacity_tokens", "doc_id", "tokens", "pieces", F.lit(None).cast("bigint").alias("container"))
    return packed.unionByName(full)


def found(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(capacity_tokens, doc_id) of documents that the packing cut: those in more than one container."""
    return pack_all(documents, containers).where("pieces > 1").select("capacity_tokens", "doc_id").distinct()


def report(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """Per capacity: documents, containers, the least that could hold all tokens, and the filled share."""
    p = pack_all(documents, containers)
    own = F.when(F.col("tokens") > F.col("capacity_tokens"), F.floor(F.col("tokens") / F.col("capacity_tokens"))).when(F.col("container").isNull(), 1).otherwise(0)
    g = p.groupBy("capacity_tokens").agg(F.count("*").alias("n_documents"), F.sum("tokens").alias("tokens"), (F.max("container") + 1).alias("shared"), F.sum(own).alias("own"))
    n = F.coalesce("shared", F.lit(0)) + F.col("own")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return g.select("capacity_tokens", "n_documents", n.alias("n_containers"), least.cast("bigint").alias("least_containers"), F.round(F.col("tokens") / (n * F.col("capacity_tokens")), 5).alias("fill"))
