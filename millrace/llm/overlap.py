"""Same or near-same records across splits: winnowed fingerprints, chained seeds and alignment.

Each text (without its source's furniture) gives the rolling hashes of its word shingles. A seed is a shingle together
with the least hash of the window of shingles that follows it, so two passages a few words apart must both survive; that
makes seeds far rarer by chance than runs of the same number of words, and edits between the two do no harm. Texts equal
in all words form one class, so copies are compared once. Classes with a train member are joined with classes with a
validation or test member on their seeds. A shared seed counts where an alignment through it can still hold enough words
by the lengths before and after it; NEEDED of them make a pair. Pairs whose counts of words by hash rule a match out are
dropped; of the rest the shared shingles are chained collinearly and the chain is extended by alignment between its
links. Where that alone doesn't reach the threshold, the full alignment (longest common subsequence of words) decides.

Seeds are written once and shuffled once, as three numbers: a seed, a class, and its length and position; of copies on
one side one stands for all. The evaluation classes of a seed that more than HOT of them hold are dealt into parts of
about HOT, and its train classes meet each part, so no task gets a whole family and no seed is left out.

Null and empty texts match nothing; a uid without a row in the manifest has no split and is left out; repeated rows
count once. If the rows of one uid name different splits or texts, the smallest split name and the least row are taken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded, source_of
from .furniture import attach, furniture_lines
from .text import BASE, chunks, codes, line_keys, lists, mix, words

SIMILARITY = 0.8
#: Kinds of seeds: words of a shingle, the window in which its partner is looked for (from, to), and the longest text
#: that carries them. Texts that may match one another always share a kind.
KINDS = ((3, 4, 12, 1 << 62), (2, 2, 8, 63), (1, 1, 6, 19))
#: A kind gives a text about so many seeds; of longer texts those with the least hashes are taken, so that a longer
#: text's choice is part of a shorter one's.
DENSITY = 128
#: Shared seeds that a pair must have to be aligned. A seed that a text repeats, or one of a text of fewer than FEW
#: words, counts as so many.
NEEDED, FEW = 2, 40
#: A seed and its position share 63 bits; the last position stands for repeated seeds and for any beyond.
PLACE = 16
ANY = (1 << PLACE) - 1
#: Words are counted by hash in so many classes, up to 255 each.
BAG = 64
#: A seed's evaluation classes are joined in parts of about so many.
HOT = 300
TRAIN, EVAL = 1, 2
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j : n + j]
    return mix(out)


def seeds_of(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of many texts' word hashes, each with its position in the lowest PLACE bits, and where each text's
    start. Seeds are distinct within a text."""
    size = np.diff(start)
    doc = np.repeat(np.arange(len(size)), size)
    found, owner = [], []
    for kind, (k, lo, hi, longest) in enumerate(KINDS):
        f = rolling(h, k)
        at = np.arange(len(f))
        d = doc[: len(f)]
        left = start[d + 1] - k - at  # shingles of the same text that follow
        g = mix(f ^ np.uint64(BASE + kind))
        partner = np.full(len(f), MOST)
        for step in range(lo, hi):
            x = np.full(len(f), MOST)
            x[: max(0, len(f) - step)] = g[step:]
            partner = np.minimum(partner, np.where(step <= left, x, MOST))
        # A text too short for a partner has its shingles alone.
        alone = (size - k - lo < 0)[d] & (left >= 0)
        share = np.maximum(1, np.exp2(np.ceil(np.log2(np.maximum(1, size - k + 1) / DENSITY)))).astype(np.uint64)
        ok = ((left >= lo) | alone) & (size[d] <= longest) & ((f >> np.uint64(40)) & (share[d] - np.uint64(1)) == 0)
        i = np.flatnonzero(ok)
        s = mix(f[i] * np.uint64(BASE) + partner[i] + np.uint64(kind)) >> np.uint64(PLACE + 1)
        p = np.minimum(i - start[d[i]], ANY).astype(np.uint64)
        found.append(s << np.uint64(PLACE) | p)
        owner.append(d[i])
    s, d = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    seed = s >> np.uint64(PLACE)
    first = np.ones(len(s), bool)
    first[1:] = (seed[1:] != seed[:-1]) | (d[1:] != d[:-1])
    again = np.append(~first[1:], False)
    s = np.where(again, s | np.uint64(ANY), s)[first]
    return s, np.searchsorted(d[first], np.arange(len(size) + 1))


def bags(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Counts of each text's words by hash. Two texts have at most (n + m - sum of differences) / 2 words in common."""
    n = len(start) - 1
    doc = np.repeat(np.arange(n), np.diff(start))
    return np.minimum(np.bincount(doc * BAG + (h & np.uint64(BAG - 1)).astype(np.int64), minlength=n * BAG), 255).astype(np.uint8).reshape(n, BAG)


def wholes(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number per text that its words in their order give; 0 for a text without words."""
    size = np.diff(start)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        k = np.arange(len(h)) - np.repeat(start[:-1], size)
        x = mix(h + k.astype(np.uint64) * np.uint64(BASE))
        out[full] = np.maximum(mix(np.bitwise_xor.reduceat(x, start[:-1][full]) + size[full].astype(np.uint64)), np.uint64(1))
    return out


def _kept_words(b: pa.RecordBatch):
    """Word hashes of a batch without furniture lines, and where each text's start."""
    cp, start = codes(b.column("text"))
    w = words(cp, start, lines=True)
    keys, line_start = line_keys(cp, start)
    bad = furniture_lines(keys, line_start, b.column("furniture"))
    doc = np.repeat(np.arange(b.num_rows), np.diff(w.start))
    keep = ~bad[line_start[doc] + w.line] if len(doc) else np.zeros(0, bool)
    begin = np.zeros(b.num_rows + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=b.num_rows), out=begin[1:])
    return w.hash[keep], begin


PRINTS = "uid string, n int, whole bigint, bag binary, seeds array<bigint>"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        h, start = _kept_words(b)
        seeds, at = seeds_of(h, start)
        whole = wholes(h, start)
        out = [b.column("uid"), np.diff(start).astype(np.int32), pa.array(whole.view(np.int64), pa.int64(), mask=whole == 0), pa.array([x.tobytes() for x in bags(h, start)], pa.binary()), lists(seeds.view(np.int64), at, pa.int64())]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=[x.split()[0] for x in PRINTS.split(", ")])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        h, start = _kept_words(b)
        # Within a pair of texts 32 bits tell words apart.
        yield pa.RecordBatch.from_arrays([b.column("uid"), lists(h.astype(np.uint32).view(np.int32), start, pa.int32())], names=["uid", "words"])


def chain(a: np.ndarray, b: np.ndarray, k: int = 3) -> list[tuple[int, int]]:
    """The longest collinear chain of runs of k words that each text holds once: positions in both, ascending."""
    fa, fb = rolling(a, k), rolling(b, k)
    one = []
    for f in (fa, fb):
        u, first, n = np.unique(f, return_index=True, return_counts=True)
        one.append((u[n == 1], first[n == 1]))
    _, i, j = np.intersect1d(one[0][0], one[1][0], True, True)
    links = sorted(zip(one[0][1][i].tolist(), one[1][1][j].tolist(), strict=True))
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for x, (_, q) in enumerate(links):
        p = bisect_left(ends, q)
        back.append(at[p - 1] if p else -1)
        ends[p : p + 1], at[p : p + 1] = [q], [x]
    out, x = [], at[-1] if at else -1
    while x >= 0:
        out.append(links[x])
        x = back[x]
    return out[::-1]


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for w in b:
        u = s & at.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def extended(a: np.ndarray, b: np.ndarray, k: int = 3) -> int:
    """Words in common in order along the chain: those of its links, and what alignment finds between them."""
    x, y = a.tolist(), b.tolist()
    total = i = j = 0
    for p, q in chain(a, b, k):
        if p < i or q < j:
            # The link overlaps the one before it: what sticks out goes on, if by as much in both texts.
            rest = min(p + k - i, q + k - j)
            if p - i != q - j or rest <= 0:
                continue
            total += rest
            i, j = i + rest, j + rest
            continue
        total += common_in_order(x[i:p], y[j:q]) + k
        i, j = p + k, q + k
    return total + common_in_order(x[i:], y[j:])


def alignment(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common in order, exactly or below the threshold: by the extended chain where it reaches the threshold,
    else by full alignment."""
    need = SIMILARITY * max(len(a), len(b))
    # Words in common in any order bound those in order.
    most = (Counter(a.tolist()) & Counter(b.tolist())).total()
    if most < need:
        return most
    got = extended(a, b)
    return got if got >= need else common_in_order(a.tolist(), b.tolist())


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shared = []
        for x, y in zip(b.column("words_a"), b.column("words_b"), strict=True):
            shared.append(alignment(*(np.asarray(z.values).view(np.uint32).astype(np.uint64) for z in (x, y))))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("whole_a", "whole_b", "n_a", "n_b")), pa.array(shared, pa.int32())], names=["whole_a", "whole_b", "n_a", "n_b", "shared"])


def members(build: DataFrame, manifest: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, side, n, whole, bag), one row per uid with a split and a text, side TRAIN or EVAL; and the fingerprints
    (PRINTS) of all rows. Both are cut from their lineage."""
    split = manifest.where("uid is not null and split is not null").groupBy("uid").agg(F.min("split").alias("split"))
    side = split.select("uid", F.when(F.col("split").isin("validation", "test"), EVAL).otherwise(TRAIN).alias("side"))
    prints = cut(attach(build, frequent).where("uid is not null and text is not null").mapInArrow(_prints, PRINTS).where("whole is not null"))
    one = prints.groupBy("uid").agg(F.min(F.struct("n", "whole", "bag")).alias("r"))
    return cut(one.join(side, "uid").select("uid", "side", "r.n", "r.whole", "r.bag")), prints


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bags leave room for a match."""
    for b in batches:
        n, m = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for c in ("bag_a", "bag_b"))
        room = (n + m - np.abs(x - y).sum(1)) / 2
        keep = pa.array(room >= SIMILARITY * np.maximum(n, m))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("whole_a", "whole_b")], names=["whole_a", "whole_b"])


def _low(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(ANY)).cast("int")


def seed_pairs(who: DataFrame, prints: DataFrame) -> DataFrame:
    """(whole_a, whole_b): classes of different texts, the first with a train, the second with an evaluation member,
    that share seeds enough and may match by their lengths and words."""
    # Of copies on one side, one stands for all.
    one = cut(who.groupBy("whole", "side").agg(F.min("uid").alias("uid")))
    every = prints.join(bounded(one), ["uid", "whole"])
    every = every.select("side", F.col("whole").alias("c"), F.shiftleft(F.col("n").cast("bigint"), PLACE).alias("n"), F.explode("seeds").alias("x"))
    every = every.select("side", "c", F.shiftright("x", PLACE).alias("seed"), F.col("n").bitwiseOR(F.col("x").bitwiseAND(F.lit(ANY))).alias("np"))
    a, b = (every.where(F.col("side") == s).drop("side") for s in (TRAIN, EVAL))
    hot = cut(b.groupBy("seed").agg(F.count("*").alias("df")).where(F.col("df") > HOT).select("seed", F.ceil(F.col("df") / HOT).cast("int").alias("parts")))
    if not hot.isEmpty():
        part = F.when(F.col("parts").isNull(), F.col("seed")).otherwise(F.xxhash64("seed", "part")).alias("seed")
        dealt = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
        b = b.join(bounded(hot), "seed", "left").withColumn("part", dealt).select("c", part, "np")
        parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        a = a.join(bounded(hot), "seed", "left").withColumn("part", F.explode(parts)).select("c", part, "np")
    a, b = (x.select("seed", F.col("c").alias(f"c_{k}"), F.col("np").alias(f"np_{k}")) for x, k in ((a, "a"), (b, "b")))
    n_a, n_b = (F.shiftright(c, PLACE) for c in ("np_a", "np_b"))
    p_a, p_b = _low("np_a"), _low("np_b")
    repeated = (p_a == ANY) | (p_b == ANY)
    # What an alignment through the seed can hold: the lesser length before it and the lesser length after it.
    held = F.least(p_a, p_b) + F.least(n_a - p_a, n_b - p_b)
    fits = (n_a >= SIMILARITY * n_b) & (n_b >= SIMILARITY * n_a) & (repeated | (held >= SIMILARITY * F.greatest(n_a, n_b)))
    met = a.join(b, "seed").where(fits & (F.col("c_a") != F.col("c_b")))
    met = met.groupBy("c_a", "c_b").agg(F.sum(F.when(repeated | (F.least(n_a, n_b) < FEW), NEEDED).otherwise(1)).alias("shared")).where(F.col("shared") >= NEEDED)
    met = cut(met.select(F.col("c_a").alias("whole_a"), F.col("c_b").alias("whole_b")))
    size = who.select("whole", "n", "bag").dropDuplicates(["whole"])
    x, y = (size.select(*(F.col(c).alias(f"{c}_{k}") for c in ("whole", "n", "bag"))) for k in "ab")
    return met.join(x, "whole_a").join(y, "whole_b").mapInArrow(_likely, "whole_a bigint, whole_b bigint")


def class_pairs(build: DataFrame, frequent: DataFrame, who: DataFrame, prints: DataFrame) -> DataFrame:
    """(whole_a, whole_b, n_a, n_b, shared): classes of different texts that match, aligned."""
    near = cut(seed_pairs(who, prints))
    wanted = cut(near.select(F.explode(F.array("whole_a", "whole_b")).alias("whole")).distinct())
    wanted = cut(who.select("whole", "uid").join(bounded(wanted), "whole", "left_semi").groupBy("whole").agg(F.min("uid").alias("uid")))
    texts = attach(build.where("text is not null").join(bounded(wanted.select("uid")), "uid", "left_semi"), frequent)
    texts = texts.mapInArrow(_hashes, "uid string, words array<int>")
    texts = cut(texts.groupBy("uid").agg(F.min("words").alias("words")).join(wanted, "uid").select("whole", "words"))
    a = texts.select(F.col("whole").alias("whole_a"), F.col("words").alias("words_a"), F.size("words").alias("n_a"))
    b = texts.select(F.col("whole").alias("whole_b"), F.col("words").alias("words_b"), F.size("words").alias("n_b"))
    # The pairs are few bytes and much work, so they are spread by number and not by size.
    both = near.join(a, "whole_a").join(b, "whole_b").repartition(int(build.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    aligned = both.mapInArrow(_align, "whole_a bigint, whole_b bigint, n_a int, n_b int, shared int")
    return cut(aligned.where(F.col("shared") >= SIMILARITY * F.greatest("n_a", "n_b")))


def overlaps(build: DataFrame, manifest: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (uid, side, whole) and matching class pairs (whole_a, whole_b, coverage), equal texts included."""
    who, prints = members(build, manifest, frequent)
    near = class_pairs(build, frequent, who, prints).select("whole_a", "whole_b", (F.col("shared") / F.greatest("n_a", "n_b")).alias("coverage"))
    both = who.groupBy("whole").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where((F.col("lo") == TRAIN) & (F.col("hi") == EVAL))
    same = both.select(F.col("whole").alias("whole_a"), F.col("whole").alias("whole_b"), F.lit(1.0).alias("coverage"))
    return who.select("uid", "side", "whole"), cut(near.unionByName(same))


def found(build: DataFrame, manifest: DataFrame, frequent: DataFrame) -> DataFrame:
    """(uid_a, uid_b), uid_a < uid_b: all pairs of a train and an evaluation record that match."""
    who, pairs = overlaps(build, manifest, frequent)
    some = cut(pairs.select(F.explode(F.array("whole_a", "whole_b")).alias("whole")).distinct())
    who = who.join(bounded(some), "whole", "left_semi")
    train = who.where(F.col("side") == TRAIN).select(F.col("whole").alias("whole_a"), F.col("uid").alias("u"))
    held = who.where(F.col("side") == EVAL).select(F.col("whole").alias("whole_b"), F.col("uid").alias("v"))
    out = pairs.join(train, "whole_a").join(held, "whole_b")
    return out.select(F.least("u", "v").alias("uid_a"), F.greatest("u", "v").alias("uid_b")).distinct()


def report(build: DataFrame, manifest: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per split and source, the evaluation records, those met again in train and their mean coverage."""
    who, pairs = overlaps(build, manifest, frequent)
    split = manifest.where("uid is not null and split is not null").groupBy("uid").agg(F.min("split").alias("split"))
    src = build.where("uid is not null").groupBy("uid").agg(F.min(source_of(F.col("source_path"))).alias("src"))
    best = pairs.groupBy(F.col("whole_b").alias("whole")).agg(F.max("coverage").alias("coverage"))
    rows = who.where(F.col("side") == EVAL).join(best, "whole", "left").join(split, "uid").join(src, "uid")
    return rows.groupBy("split", "src").agg(F.count("*").alias("n_records"), F.count("coverage").alias("n_overlapping"), F.round(F.avg("coverage"), 4).alias("mean_coverage"))
