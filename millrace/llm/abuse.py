"""Abusive, hateful or sexual content: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are folded; stretched letters, letters set apart, masking signs and digits used as letters are undone. Every
position of a text has its n-grams of the lengths ORDERS, hashed; a text's score is that of its worst window of WINDOW
characters, so that one sentence in a long text counts. The ratios come from the labelled documents (presence per
document); the weights on top are logistic, trained on windows: of a document labelled harmful its worst window, of
the others their worst one and one at an even place. Documents labelled harmful that held-out fits don't confirm are
taken for annotators' errors and left out of the final fit. Known terms (a
small, fixed list) join as labelled texts unless the labelled documents show them in harmless use.

Fitted on at most POSITIVES and NEGATIVES labelled documents with the least hashes of doc_id, of SAMPLE_BYTES in all (the
parameters bound the driver's share); every document is scored, whole. Null and empty texts score null and are never found. A document's
label is the mean of its annotators' (nulls aside), harmful from HARMFUL on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded
from .text import DROP, SPACE, chunks, codes, fold_table

ORDERS = (2, 3, 4, 5)
BITS = 19
WINDOW = 40
POSITIVES, NEGATIVES = 1000, 3500
#: Bytes of text that the sample may have; documents beyond, in the order of their hashes, are passed over.
SAMPLE_BYTES = 32_000_000
HARMFUL = 0.5
FOLDS, ROUNDS = 3, 6


@cache
def _table() -> np.ndarray:
    out = fold_table().copy()
    for c in "*#_·~^'’`":
        out[ord(c)] = DROP
    for a, b in zip("013457@$", "oieastas", strict=True):
        out[ord(a)] = ord(b)
    out[10] = SPACE
    return out


def squeeze(cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and single spaces of all texts, each text begun and ended by a space, and where each starts."""
    n = len(start) - 1
    g = np.insert(_table()[cp], np.sort(np.concatenate([start[:-1], start[1:]])), SPACE)
    at = start + 2 * np.arange(n + 1)
    keep = g != DROP
    pos = np.zeros(len(g) + 1, np.int64)
    np.cumsum(keep, out=pos[1:])
    g, at = g[keep], pos[at]
    edge = np.zeros(len(g), bool)
    edge[at[:n]] = True
    # Runs of three or more equal letters count as one; so do runs of spaces.
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & ~edge[1:]
    begin = np.flatnonzero(~same)
    size = np.diff(np.append(begin, len(g)))
    long = np.repeat((size >= 3) | (g[begin] == SPACE), size)
    g, at, edge = _drop(g, at, edge, same & long)
    # Single letters set apart: the space between two of them goes.
    sp = g == SPACE
    lone = np.zeros(len(g), bool)
    if len(g) > 2:
        lone[1:-1] = ~sp[1:-1] & sp[:-2] & sp[2:]
        gone = np.zeros(len(g), bool)
        gone[1:-1] = sp[1:-1] & lone[:-2] & lone[2:] & ~edge[1:-1]
        g, at, edge = _drop(g, at, edge, gone)
    return g, at


def _drop(g: np.ndarray, at: np.ndarray, edge: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = ~gone
    pos = np.zeros(len(g) + 1, np.int64)
    np.cumsum(keep, out=pos[1:])
    return g[keep], pos[at], edge[keep]


def grams(g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Per order, the hashed n-gram at every position (slot 0 where it would leave its text)."""
    out = []
    h = np.zeros(len(g), np.uint32)
    left = (np.repeat(at[1:], np.diff(at)) - np.arange(len(g))).astype(np.int32)
    for k in range(max(ORDERS)):
        x = np.zeros(len(g), np.uint32)
        x[: max(0, len(g) - k)] = g[k:]
        h = (h ^ x) * np.uint32(16777619) + np.uint32(k)
        if k + 1 in ORDERS:
            i = ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
            out.append(np.where(left > k, np.maximum(i, 1), 0).astype(np.int32))
    return out


def window_sums(weight: np.ndarray, ids: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Score of the window that begins at each position (cut at its text's end)."""
    n = len(ids[0])
    s = np.zeros(n + 1)
    total = weight[ids[0]]
    for i in ids[1:]:
        total = total + weight[i]
    np.cumsum(total, out=s[1:])
    stop = np.minimum(np.arange(n) + WINDOW, np.repeat(at[1:], np.diff(at)))
    return s[stop] - s[:n]


def worst(weight: np.ndarray, ids: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the highest window score and where that window begins. No text is empty (each has its spaces)."""
    w = window_sums(weight, ids, at)
    top = np.maximum.reduceat(w, at[:-1])
    hit = np.flatnonzero(w == np.repeat(top, np.diff(at)))
    doc = np.searchsorted(at, hit, "right") - 1
    where = np.zeros(len(at) - 1, np.int64)
    where[doc[::-1]] = hit[::-1]
    return top, where


def worst_by_blocks(weight: np.ndarray, ids: list[np.ndarray], at: np.ndarray, block: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """worst(), some texts at a time."""
    tops, wheres = [], []
    for lo in range(0, len(at) - 1, block):
        hi = min(lo + block, len(at) - 1)
        a, b = int(at[lo]), int(at[hi])
        top, where = worst(weight, [i[a:b] for i in ids], at[lo : hi + 1] - a)
        tops.append(top)
        wheres.append(where + a)
    return np.concatenate(tops), np.concatenate(wheres)


class Sample:
    """The labelled texts as n-grams, and one fit of weights on windows of them."""

    def __init__(self, texts: list[str], harmful: np.ndarray, terms: list[str] = ()):
        """Known terms join as texts labelled harmful."""
        self.harmful = np.concatenate([harmful, np.ones(len(terms), bool)])
        self.term = np.concatenate([np.zeros(len(texts), bool), np.ones(len(terms), bool)])
        g, self.at = squeeze(*codes(pa.array([*texts, *terms], pa.string())))
        self.ids = grams(g, self.at)
        self.slots = 1 << BITS
        docs, slots = [], []
        for lo in range(0, len(self.harmful), 500):
            # Distinct n-grams of each text, some texts at a time, so that the driver holds little at once.
            hi = min(lo + 500, len(self.harmful))
            a, b = int(self.at[lo]), int(self.at[hi])
            doc = np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(self.at[lo : hi + 1]))
            for i in self.ids:
                met = np.unique(doc * self.slots + i[a:b])
                docs.append((met >> BITS).astype(np.int32))
                slots.append((met & (self.slots - 1)).astype(np.int32))
        self.doc, self.slot = np.concatenate(docs), np.concatenate(slots)
        self.even = np.random.default_rng(5).random(len(self.harmful))

    def ratio(self, use: np.ndarray) -> np.ndarray:
        """Log-count ratio of every slot between the used harmful and harmless texts; 0 where neither has it."""
        y = self.harmful & use
        pos, neg = max(1, int(y.sum())), max(1, int((use & ~self.harmful).sum()))
        p = np.bincount(self.slot[y[self.doc]], minlength=self.slots)
        q = np.bincount(self.slot[(use & ~self.harmful)[self.doc]], minlength=self.slots)
        r = np.log((p + pos / (pos + neg)) / pos) - np.log((q + neg / (pos + neg)) / neg)
        r[0] = 0
        return r

    def even_windows(self, use: np.ndarray) -> np.ndarray:
        at = self.at
        return (at[:-1] + (self.even * np.maximum(1, np.diff(at) - WINDOW // 2)).astype(np.int64))[use & ~self.harmful]

    def fit(self, use: np.ndarray, weight: np.ndarray, harmless: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
        """Logistic weights on ratio-scaled n-gram counts of windows: the worst one (by weight) of every used harmful
        text, and the harmless windows that begin at the given positions."""
        ratio, at = self.ratio(use), self.at
        _, where = worst_by_blocks(weight, self.ids, at)
        begin = np.concatenate([where[use & self.harmful], harmless])
        label = np.zeros(len(begin))
        label[: len(begin) - len(harmless)] = 1
        owner = np.searchsorted(at, begin, "right") - 1
        size = np.minimum(begin + WINDOW, at[owner + 1]) - begin
        row = np.repeat(np.arange(len(begin), dtype=np.int32), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        row, col = np.tile(row, len(self.ids)), np.concatenate([i[pos] for i in self.ids])
        active, col = np.unique(col, return_inverse=True)
        col = col.astype(np.int32)
        scale = ratio[active]
        x = scale[col]
        v, bias, gv, gb = np.full(len(active), 0.02), -2.0, np.full(len(active), 1e-8), 1e-8
        cost = np.where(label > 0, max(1.0, 0.3 * len(harmless) / max(1, label.sum())), 1.0)
        cost /= cost.sum()
        for _ in range(rounds):
            z = np.bincount(row, v[col] * x, len(begin)) + bias
            e = (label - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * cost
            grad = np.bincount(col, e[row] * x, len(active)) - 1e-4 * v
            gv += grad * grad
            gb += e.sum() ** 2
            v += 0.05 * grad / np.sqrt(gv)
            bias += 0.5 * e.sum() / np.sqrt(gb)
        out = np.zeros(self.slots)
        out[active] = v * scale
        return out, bias

    def mined(self, use: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Fits in rounds, each with the harmless texts' windows that the one before took for nearly harmful."""
        clean = use & ~self.harmful
        _, where = worst_by_blocks(weight, self.ids, self.at)
        harmless = np.concatenate([self.even_windows(use), where[clean]])
        for _ in range(rounds):
            weight, bias = self.fit(use, weight, harmless)
            top, where = worst_by_blocks(weight, self.ids, self.at)
            harmless = np.unique(np.concatenate([harmless, where[clean & (top + bias > -1)]]))
        return weight, bias


def reliable(texts: list[str], harmful: np.ndarray, terms: list[str]) -> list[str]:
    """The terms that no more harmless than harmful texts use, if more than one harmless text uses them at all."""

    def plain(xs: list[str]) -> list[str]:
        g, at = squeeze(*codes(pa.array(xs, pa.string())))
        s = g.tobytes().decode("utf-32-le")
        return [s[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    seen, out = plain(texts), []
    for t, p in zip(terms, plain(terms) if terms else [], strict=True):
        has = np.array([p in x for x in seen], bool)
        if (has & ~harmful).sum() <= max(1, (has & harmful).sum()):
            out.append(t)
    return out


def fit(texts: list[str], harmful: np.ndarray, terms: list[str] = ()) -> tuple[np.ndarray, float]:
    """Weights per slot and the bias. Labels are checked by FOLDS held-out fits: a text labelled harmful that neither
    they nor a known term confirm is left out as an annotator's error."""
    s = Sample(texts, harmful, reliable(texts, harmful, list(terms)))
    n = len(s.harmful)
    start = lambda use: np.where((r := s.ratio(use)) > 0, np.where(np.bincount(s.slot[(s.harmful & use)[s.doc]], minlength=s.slots) >= 2, r, 0), r)
    fold = np.arange(n) % FOLDS
    confirmed = np.zeros(n, bool)
    for k in range(FOLDS):
        use = (fold != k) | s.term
        weight, bias = s.mined(use, start(use), 1)
        confirmed |= (fold == k) & (worst_by_blocks(weight, s.ids, s.at)[0] + bias > 0)
    use = ~s.harmful | confirmed | s.term
    return s.mined(use, start(use), ROUNDS)


def sample(documents: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the bounded training sample."""
    per = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg((F.avg("abusive") >= HARMFUL).alias("harmful"))
    h = F.xxhash64("doc_id")
    some = per.where("harmful").orderBy(h, "doc_id").limit(POSITIVES).unionByName(per.where("not harmful").orderBy(h, "doc_id").limit(NEGATIVES))
    texts = documents.where("text is not null and text <> ''").select("doc_id", "text").join(bounded(cut(some)), "doc_id")
    left, taken = SAMPLE_BYTES, []
    for r in texts.select("doc_id", h.alias("h"), F.octet_length("text").alias("n")).orderBy("h", "doc_id").collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["doc_id"],))
    keep = documents.sparkSession.createDataFrame(taken, "doc_id bigint").distinct()
    got = texts.join(F.broadcast(keep), "doc_id").orderBy("doc_id").toPandas()
    return got["text"].tolist(), got["harmful"].to_numpy(bool)


def scored(documents: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, source, score): each document's log odds of harmful content, null without a text."""
    texts, harmful = sample(documents, labels)
    known = sorted({r["term"] for r in terms.where("term is not null").select("term").toLocalIterator()})
    if harmful.any() and not harmful.all():
        weight, bias = fit(texts, harmful, known)
    else:
        weight, bias = np.zeros(1 << BITS), -1.0
    model = documents.sparkSession.sparkContext.broadcast((weight.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        for b in chunks(batches, "text", 1 << 20):
            g, at = squeeze(*codes(b.column("text")))
            top, _ = worst(w, grams(g, at), at)
            none = np.asarray(pc.binary_length(b.column("text")).fill_null(0)) == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.round(top + b0, 4), mask=none)], names=["doc_id", "source", "score"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")


def found(documents: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    return scored(documents, labels, terms).where("score > 0 and doc_id is not null").select("doc_id").distinct()


def report(documents: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """Per source: documents with a text, flagged ones, their rate and the mean probability."""
    s = scored(documents, labels, terms).where("score is not null")
    flag = (F.col("score") > 0).cast("int")
    return s.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(flag).alias("n_flagged"), F.round(F.avg(flag), 5).alias("rate"), F.round(F.avg(1 / (1 + F.exp(-F.col("score")))), 5).alias("mean_probability"))
