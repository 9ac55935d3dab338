"""Language of every document and of every part of a mixed one, by a linear-chain conditional random field.

Words are labelled in context: features are a word's affixes, character n-grams and membership in the languages' lists
of common words; first states and transitions are learned. The field is trained here, by gradient ascent on the exact
conditional likelihood (forward-backward; words without a label are summed over), on a bounded sample of SAMPLE records
whose words are labelled by the common words that only one language has, voting over the neighbouring words of their
line. Words of a script that none of the languages uses are of the state other. Decoding takes each word's most probable
label; passages are runs of one label, where runs of a few words inside another language are part of it. A passage's
confidence is the mean posterior of its words.

Furniture lines, words with digits and items of personal data don't count. Null, empty and very short texts have no
passage and no language. Where the rows of one uid carry different labels, the row emitted last decides (ties: least
label).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded
from .furniture import attach, furniture_lines
from .lexicon import COMMON, LANGUAGES
from .pii import _names, find
from .quality import not_prose
from .sequences import forward_backward
from .text import Words, chunks, codes, line_keys, words

SAMPLE = 1200
#: Bytes of text that the sample may have; records beyond, in the order of their hashes, are passed over.
SAMPLE_BYTES = 24_000_000
#: For training, texts are cut into sequences of at most so many words; they are decoded whole.
SPAN = 512
#: What the field tells apart: the languages, and any other, which a script that none of them uses gives away.
STATES = (*LANGUAGES, "other")
BUCKETS = 1 << 14
ROUNDS = 40
#: A run of fewer words between two others belongs to the passage before it.
ISLAND = 6
PASSAGE = 20
MISSING = ("", "und", "unknown", "no_signal")


def _fold(w: str) -> str:
    cp, start = codes(pa.array([w]))
    x = words(cp, start)
    return "".join(chr(c) for c in x.folded if c > 32)


LEXICON: dict[str, list[int]] = {}
for _i, _l in enumerate(LANGUAGES):
    for _w in COMMON[_l].split():
        LEXICON.setdefault(_fold(_w), []).append(_i)


def features(w: str) -> list[int]:
    """Feature numbers of a folded word: affixes of 1 to 3, bigrams and trigrams, script, lists of common words."""
    s = f"^{w}$"
    names = [f"p{w[:n]}" for n in (1, 2, 3)] + [f"s{w[-n:]}" for n in (1, 2, 3)]
    names += [s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)]
    names.append("latin" if w.isascii() else "other")
    out = {len(STATES) + hash_name(x) % (BUCKETS - len(STATES)) for x in names}
    own = {FOREIGN} if foreign(w) else set(LEXICON.get(w, ()))
    return sorted(out | own)


#: The feature of a word in a script of none of the languages, and its fixed weight for the state other.
FOREIGN, FOREIGN_WEIGHT = len(LANGUAGES), 30.0


def foreign(w: str) -> bool:
    """Whether most letters of a word are neither Latin nor Arabic."""
    n = sum(1 for c in w if c.isalpha() and not (c < "\u0250" or "\u0600" <= c <= "\u08ff" or "\ufb50" <= c <= "\ufeff"))
    return 2 * n > len(w)


def hash_name(s: str) -> int:
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


class Vocabulary:
    """Features of the distinct words of a batch, flat with starts."""

    def __init__(self, w: Words, keep: np.ndarray):
        h = w.hash[keep]
        self.hashes, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        at = np.flatnonzero(keep)[first]
        self.words = [w.folded[a:b].tobytes().decode("utf-32-le", "replace") for a, b in zip(w.fold_first[at].tolist(), w.fold_end[at].tolist(), strict=True)]


def flat(lists_: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists_], np.int64)
    start = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    return (np.concatenate([np.array(x, np.int64) for x in lists_]) if lists_ else np.zeros(0, np.int64)), start


class Field:
    def __init__(self) -> None:
        k = len(STATES)
        self.weight = np.zeros((BUCKETS, k))
        self.fixed = np.zeros(k)
        self.fixed[-1] = FOREIGN_WEIGHT
        self.move = np.zeros((k, k))
        self.first = np.zeros(k)
        self.cache_h = np.zeros(0, np.uint64)
        self.cache_e = np.zeros((0, k))

    def emissions(self, lists_: list[list[int]]) -> np.ndarray:
        f, s = flat(lists_)
        if not len(f):
            return np.zeros((0, len(STATES)))
        out = np.add.reduceat(self.weight[f], s[:-1])
        # A word of a foreign script is other, whatever was learned; no other word is.
        odd = np.add.reduceat((f == FOREIGN).astype(np.int64), s[:-1]) > 0
        out[~odd, -1] -= FOREIGN_WEIGHT
        out[odd] += self.fixed
        return out

    def scores(self, v: Vocabulary) -> np.ndarray:
        """Emission scores of a vocabulary; words met before in this process aren't computed again."""
        if len(self.cache_h) > 400_000:
            self.cache_h, self.cache_e = self.cache_h[:0], self.cache_e[:0]
        at = np.minimum(np.searchsorted(self.cache_h, v.hashes), max(0, len(self.cache_h) - 1))
        known = self.cache_h[at] == v.hashes if len(self.cache_h) else np.zeros(len(v.hashes), bool)
        new = np.flatnonzero(~known)
        if len(new):
            e = self.emissions([features(v.words[i]) for i in new.tolist()])
            h = np.concatenate([self.cache_h, v.hashes[new]])
            order = np.argsort(h, kind="stable")
            self.cache_h, self.cache_e = h[order], np.concatenate([self.cache_e, e])[order]
            at = np.searchsorted(self.cache_h, v.hashes)
        return self.cache_e[at]

    def posteriors(self, emission: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(emission - emission.max(1, keepdims=True)) if len(emission) else emission
        post, moves, _ = forward_backward(e, start, np.exp(self.first), np.exp(self.move))
        return post, moves

    def train(self, lists_: list[list[int]], ids: np.ndarray, start: np.ndarray, gold: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-4, rate: float = 0.5) -> None:
        """AdaGrad on the conditional likelihood of all labelled words; gold -1 is no label, and such words are summed
        over."""
        sums = [np.full(x.shape, 1e-6) for x in (self.weight, self.move, self.first)]
        n = max(1, len(ids))
        for _ in range(rounds):
            _, grads = self.likelihood(lists_, ids, start, gold)
            for x, grad, q in zip((self.weight, self.move, self.first), grads, sums, strict=True):
                grad = grad / n - l2 * x
                q += grad * grad
                x += rate * grad / np.sqrt(q)

    def likelihood(self, lists_: list[list[int]], ids: np.ndarray, start: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Log likelihood of the labels given the words, unlabelled words summed over, and its gradient by weight, move
        and first: expectations with the labels held, less those without."""
        k = len(STATES)
        f, s = flat(lists_)
        of = np.repeat(np.arange(len(lists_)), np.diff(s))
        e = self.emissions(lists_)[ids]
        held = np.where((gold >= 0)[:, None] & (np.arange(k) != gold[:, None]), -np.inf, e)
        begins = start[:-1][np.diff(start) > 0]
        total, grads = 0.0, [np.zeros_like(x) for x in (self.weight, self.move, self.first)]
        for sign, score in ((1, held), (-1, e)):
            top = e.max(1, keepdims=True)
            post, moves, log = forward_backward(np.exp(score - top), start, np.exp(self.first), np.exp(self.move))
            total += sign * log
            per = np.stack([np.bincount(ids, post[:, j], len(lists_)) for j in range(k)], 1)[of]
            for j in range(k):
                grads[0][:, j] += sign * np.bincount(f, per[:, j], BUCKETS)
            grads[1] += sign * moves
            grads[2] += sign * post[begins].sum(0)
        return total, grads


def votes(w: Words, start: np.ndarray, keep: np.ndarray, own: dict[int, int], reach: int = 8) -> np.ndarray:
    """Weak labels: the language whose own common words are most frequent around a word of the same line, else -1."""
    h = w.hash[keep]
    k = len(LANGUAGES)
    table = np.array(sorted(own), np.uint64)
    lang = np.array([own[int(x)] for x in table])
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    hit = table[at] == h
    one = np.zeros((len(h) + 1, k))
    np.add.at(one, (np.flatnonzero(hit) + 1, lang[at[hit]]), 1)
    total = np.cumsum(one, 0)
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    group = doc * 1_000_003 + w.line[keep]
    edge = np.flatnonzero(np.diff(group, prepend=-1)) if len(h) else np.zeros(0, np.int64)
    bounds = np.append(edge, len(h))
    which = np.searchsorted(bounds, np.arange(len(h)), "right") - 1
    lo = np.maximum(np.arange(len(h)) - reach, bounds[which])
    hi = np.minimum(np.arange(len(h)) + reach + 1, bounds[which + 1]) if len(h) else lo
    near = total[hi] - total[lo]
    return np.where(near.max(1) >= 2, near.argmax(1), -1) if len(h) else np.zeros(0, np.int64)


def _kept(b: pa.RecordBatch, names=None) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a batch that count, as a mask, and where each text's start among them."""
    cp, start = codes(b.column("text"))
    w = words(cp, start, lines=True)
    keys, ls = line_keys(cp, start)
    doc = np.repeat(np.arange(b.num_rows), np.diff(w.start))
    keep = np.ones(len(w.hash), bool)
    if len(doc):
        f = w.folded
        digit = np.zeros(len(f) + 1, np.int64)
        np.cumsum((f >= 48) & (f <= 57), out=digit[1:])
        keep &= digit[w.fold_end] == digit[w.fold_first]
        keep &= ~furniture_lines(keys, ls, b.column("furniture"))[ls[doc] + w.line]
        if names is not None:
            for row, _, lo, hi, _ in find(b.column("text"), names):
                i, j = np.searchsorted(w.first, [start[row] + lo, start[row] + hi])
                keep[i:j] = False
    begin = np.zeros(b.num_rows + 1, np.int64)
    np.cumsum(np.bincount(doc[keep], minlength=b.num_rows), out=begin[1:])
    return w, keep, begin


def pieces(start: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Where sequences start if long ones are cut every so many words: all advance together, so the longest decides how
    long training takes."""
    return np.unique(np.concatenate([np.arange(a, b, span) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)] + [start]))


def train(build: DataFrame, frequent: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on the records with the least hashes of uid and text, at most `sample` and SAMPLE_BYTES."""
    rows = attach(build, frequent).select("uid", "text", "furniture").where("uid is not null and text is not null")
    # A threshold on the hash lets about four times the sample through, so that no task sends more than its part.
    share = min(1.0, 4 * sample / max(1, build.count()))
    h = F.xxhash64("uid", "text")
    few = rows.withColumn("h", h).where(F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    left, taken = SAMPLE_BYTES, []
    for r in few.select("h", F.octet_length("text").alias("n")).distinct().orderBy("h").limit(sample).collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append(r["h"])
    got = few.where(F.col("h").isin(taken)).dropDuplicates(["h"]).orderBy("h").toPandas()
    b = pa.RecordBatch.from_pydict({"text": pa.array(got["text"].tolist(), pa.string()), "furniture": pa.array([None if x is None else [int(y) for y in x] for x in got["furniture"]], pa.list_(pa.int64()))})
    w, keep, start = _kept(b)
    v = Vocabulary(w, keep)
    own = {}
    for x, langs in LEXICON.items():
        if len(langs) == 1:
            cp, s = codes(pa.array([x]))
            own[int(words(cp, s).hash[0])] = langs[0]
    field = Field()
    if len(v.ids):
        field.train([features(x) for x in v.words], v.ids, pieces(start), votes(w, start, keep, own))
    return field


def runs(label: np.ndarray, start: np.ndarray, island: int = ISLAND) -> list[tuple[int, int, int, int]]:
    """(text, language, first, end) of each passage among the kept words; short runs join the one before (or after)."""
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    if not len(label):
        return []
    edge = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    out: list[tuple[int, int, int, int]] = []
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(label)).tolist(), strict=True):
        d, l = int(doc[a]), int(label[a])
        if out and out[-1][0] == d and (out[-1][1] == l or b - a < island):
            out[-1] = (d, out[-1][1], out[-1][2], b)
        elif out and out[-1][0] == d and out[-1][3] - out[-1][2] < island:
            out[-1] = (d, l, out[-1][2], b)
            if len(out) > 1 and out[-2][0] == d and out[-2][1] == l:
                _, _, first, _ = out.pop(-2)
                out[-1] = (d, l, first, b)
        else:
            out.append((d, l, a, b))
    return out


SEGMENTS = "uid string, lang string, start_at int, end_at int, n_words int, confidence double"


def segments(build: DataFrame, frequent: DataFrame, parts: DataFrame, field: Field) -> DataFrame:
    """(uid, lang, start_at, end_at, n_words, confidence): the passages of every row's text, offsets in code points."""
    sc = build.sparkSession.sparkContext
    names, shared = _names(parts), sc.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in chunks(batches, "text"):
            w, keep, start = _kept(b, names)
            if not keep.any():
                continue
            v = Vocabulary(w, keep)
            post, _ = field.posteriors(field.scores(v)[v.ids], start)
            got = runs(post.argmax(1), start)
            cum = np.vstack([np.zeros(len(STATES)), np.cumsum(post, 0)])
            _, base = codes(b.column("text"))
            d, l, a, e = (np.array(x, np.int64) for x in zip(*got, strict=True))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("uid").take(pa.array(d)),
                    pa.array([STATES[i] for i in l.tolist()]),
                    pa.array((w.first[at[a]] - base[d]).astype(np.int32)),
                    pa.array((w.end[at[e - 1]] - base[d]).astype(np.int32)),
                    pa.array((e - a).astype(np.int32)),
                    pa.array(np.round((cum[e, l] - cum[a, l]) / (e - a), 4)),
                ],
                names=[x.split()[0] for x in SEGMENTS.split(", ")],
            )

    rows = attach(build, frequent).select("uid", "text", "furniture").where("uid is not null and text is not null")
    return rows.mapInArrow(run, SEGMENTS)


def labels(build: DataFrame) -> DataFrame:
    """(uid, label): the trimmed lower-case label of each uid's row emitted last, null where it is missing."""
    l = F.lower(F.regexp_replace("language_variety", r"^\s+|\s+$", ""))
    rows = build.where("uid is not null").select("uid", F.when(~l.isin(*MISSING), l).alias("label"), "emitted_at")
    return rows.groupBy("uid").agg(F.max_by("label", F.struct("emitted_at", "label")).alias("label"))


def found(build: DataFrame, frequent: DataFrame, parts: DataFrame) -> DataFrame:
    """(uid, lang) of every record out of p1's cases whose label is missing or wrong or that has several languages."""
    junk = bounded(cut(not_prose(build, frequent)))
    rows = build.join(junk, "uid", "left_anti")
    got = segments(rows, frequent, parts, train(build, frequent)).where((F.col("n_words") >= PASSAGE) & (F.col("lang") != "other"))
    langs = got.select("uid", "lang").distinct()
    per = cut(langs.groupBy("uid").agg(F.sort_array(F.collect_list("lang")).alias("langs")))
    bad = per.join(labels(build), "uid").where((F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0]))
    return bad.select("uid", F.explode("langs").alias("lang"))
