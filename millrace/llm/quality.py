"""Per-document text quality: statistics, and shares of prose, list, table and junk lines by a hidden Markov model.

Each line (furniture of the source left out) becomes a tuple of binned statistics. A hidden Markov model over these
tuples, one categorical emission per statistic and state, starts from the stated prior tables and is re-estimated by
expectation maximisation over all records; the labels' shares of a document's characters tell prose from the rest.

Null and empty texts have no lines: all counts are 0, all shares null, and they are never found. Repeated rows of a
uid give repeated statistics; the found query is distinct.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .furniture import attach, furniture_lines
from .lexicon import COMMON
from .sequences import forward_backward
from .text import NEWLINE, SPACE, chunks, codes, fold_table, line_keys, lists, words

STATES = ("prose", "list", "table", "junk")
BINS = (4, 4, 3, 3, 3, 3, 2, 2, 2)
ROUNDS = 3
#: A text whose prose lines have a smaller share of its characters than this is not prose as a whole.
PROSE_SHARE = 0.5

#: Prior tables, one row per state: common words, words, line start, columns, digits, symbols, commas, repetition, end.
PRIOR = (
    ((0.02, 0.03, 0.15, 0.8), (0.55, 0.3, 0.1, 0.05), (0.7, 0.2, 0.05, 0.05), (0.6, 0.3, 0.06, 0.04)),
    ((0.05, 0.15, 0.4, 0.4), (0.3, 0.4, 0.2, 0.1), (0.3, 0.4, 0.2, 0.1), (0.1, 0.3, 0.3, 0.3)),
    ((0.85, 0.1, 0.05), (0.4, 0.4, 0.2), (0.85, 0.1, 0.05), (0.9, 0.05, 0.05)),
    ((0.9, 0.07, 0.03), (0.85, 0.1, 0.05), (0.1, 0.3, 0.6), (0.8, 0.1, 0.1)),
    ((0.8, 0.17, 0.03), (0.6, 0.3, 0.1), (0.1, 0.3, 0.6), (0.6, 0.2, 0.2)),
    ((0.95, 0.04, 0.01), (0.85, 0.12, 0.03), (0.6, 0.3, 0.1), (0.4, 0.2, 0.4)),
    ((0.99, 0.01), (0.8, 0.2), (0.9, 0.1), (0.95, 0.05)),
    ((0.99, 0.01), (0.98, 0.02), (0.98, 0.02), (0.6, 0.4)),
    ((0.4, 0.6), (0.95, 0.05), (0.97, 0.03), (0.95, 0.05)),
)
FIRST = (0.7, 0.12, 0.08, 0.1)
STAY = 0.85


@cache
def common_words() -> np.ndarray:
    cp, start = codes(pa.array(sorted({w for t in COMMON.values() for w in t.split()})))
    return np.unique(words(cp, start).hash)


@cache
def char_kinds() -> np.ndarray:
    """Per code point: 0 space, 1 letter, mark or digit, 2 ordinary punctuation, 3 symbol, 4 Latin-1 leftovers of a
    wrong decoding (bytes read as characters)."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x10000):
        k = unicodedata.category(chr(c))
        out[c] = 0 if k[0] == "Z" or c in (9, 10, 13) else 1 if k[0] in "LMN" or k == "Cf" else 2 if k[0] == "P" else 3
    out[0x80:0x100] = 4
    for ch in "\xa0\xad«»·©":
        out[ord(ch)] = 0 if ch == "\xa0" else 2
    return out


def _sum(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(line, values, n) if len(line) else np.zeros(n)


def line_statistics(col: pa.Array, furniture: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of every line of a batch and their binned code; start: where each text's lines start."""
    cp, start = codes(col)
    keys, ls = line_keys(cp, start)
    n = len(keys)
    w = words(cp, start, lines=True)
    doc = np.repeat(np.arange(len(col)), np.diff(w.start))
    wl = ls[doc] + w.line if len(doc) else np.zeros(0, np.int64)
    cdoc = np.repeat(np.arange(len(col)), np.diff(start))
    br = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(cp == NEWLINE, out=br[1:])
    cl = ls[cdoc] + br[:-1] - br[start[:-1]][cdoc] if len(cp) else np.zeros(0, np.int64)
    kind = char_kinds()[cp]
    n_words = np.bincount(wl, minlength=n)
    common = _sum(np.isin(w.hash, common_words()).astype(float), wl, n)
    head = w.folded[w.fold_first] if len(w.hash) else np.zeros(0, np.uint32)
    digits = _sum(((head >= 48) & (head <= 57)).astype(float), wl, n)
    filled = kind > 0
    chars = np.bincount(cl[filled], minlength=n)
    symbols = np.bincount(cl[kind == 3], minlength=n) + np.bincount(cl[kind == 4], minlength=n)
    commas = np.bincount(cl[(cp == 44) | (cp == 0x60C)], minlength=n)
    bars = np.bincount(cl[(cp == 9) | (cp == 124)], minlength=n)
    # Wide gaps and leaders: three equal characters in a row that are spaces, dots or the like.
    runs = np.zeros(n, np.int64)
    if len(cp) > 2:
        same = (cp[2:] == cp[1:-1]) & (cp[1:-1] == cp[:-2]) & ((cp[2:] == 32) | (kind[2:] == 2) & (cp[2:] != 0x640) | (cp[2:] == ord("…")) | (cp[2:] == ord("·")))
        fresh = same & ~np.concatenate([[False], same[:-1]])
        runs = np.bincount(cl[2:][fresh], minlength=n)
    # Repetition: distinct words of the line.
    distinct = np.zeros(n, np.int64)
    if len(wl):
        u = np.unique(np.stack([wl.astype(np.uint64), w.hash]), axis=1)[0].astype(np.int64) if len(wl) < 64 else None
        if u is None:
            o = np.lexsort((w.hash, wl))
            fresh = np.concatenate([[True], (w.hash[o][1:] != w.hash[o][:-1]) | (wl[o][1:] != wl[o][:-1])])
            u = wl[o][fresh]
        distinct = np.bincount(u, minlength=n)
    # First and last characters that are not spaces.
    pos = np.flatnonzero(filled)
    first_char, last_char = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    first_pos = np.full(n, -1, np.int64)
    if len(pos):
        l = cl[pos]
        a = np.flatnonzero(np.diff(l, prepend=-1))
        b = np.append(a[1:], len(l)) - 1
        first_char[l[a]], last_char[l[b]], first_pos[l[a]] = cp[pos[a]], cp[pos[b]], pos[a]
    bullet = np.isin(first_char, np.array([ord(c) for c in "-*•◦–·▪‣"], np.uint32))
    first_word = np.full(n, -1, np.int64)
    if len(wl):
        a = np.flatnonzero(np.diff(wl, prepend=-1))
        first_word[wl[a]] = a
    has = first_word >= 0
    fw = first_word[has]
    numbered, colon = np.zeros(n, bool), np.zeros(n, bool)
    if has.any():
        nxt = np.minimum(w.end[fw], len(cp) - 1)
        nxt2 = np.minimum(nxt + 1, len(cp) - 1)
        mark = np.isin(cp[nxt], np.array([ord(c) for c in ".):-"], np.uint32)) | (cp[nxt] == 32) & (cp[nxt2] == 45)
        numbered[has] = (head[fw] >= 48) & (head[fw] <= 57) & mark & (w.first[fw] == first_pos[has])
        second = np.minimum(fw + 1, len(w.hash) - 1)
        nxt3 = np.minimum(w.end[second], len(cp) - 1)
        colon[has] = (cp[nxt] == 58) | (cp[nxt3] == 58) & (wl[second] == wl[fw])
    ended = np.isin(last_char, np.array([ord(c) for c in ".!?۔؟»\"”"], np.uint32))
    nw = np.maximum(n_words, 1)
    share = common / nw
    f = [
        np.digitize(share, (1e-9, 0.1, 0.25)),
        np.digitize(n_words, (3, 7, 16)),
        np.where(bullet | numbered, 1, np.where(colon, 2, 0)),
        np.minimum(bars + runs, 2),
        np.digitize(digits / nw, (1e-9, 0.3)),
        np.digitize(symbols / np.maximum(chars, 1), (0.1, 0.3)),
        (commas > 0.4 * nw).astype(int),
        ((n_words >= 6) & (distinct < 0.6 * n_words)).astype(int),
        ended.astype(int),
    ]
    code = np.zeros(n, np.int64)
    for x, b in zip(f, BINS, strict=True):
        code = code * b + x
    keep = (chars > 0) & ~furniture_lines(keys, ls, furniture)
    letters = np.bincount(cl[fold_table()[cp] > SPACE], minlength=n) if len(cp) else np.zeros(n, np.int64)
    arabic = np.bincount(cl[(kind == 1) & (((cp >= 0x600) & (cp < 0x780)) | ((cp >= 0xFB50) & (cp < 0xFF00)))], minlength=n)
    return {"code": code, "chars": chars, "words": n_words, "common": common, "symbols": symbols, "letters": letters, "arabic": arabic, "ended": ended & (chars > 0), "keep": keep, "start": ls}


SEQUENCES = "uid string, codes array<int>, chars array<int>, n_words bigint, letters bigint, common bigint, symbols bigint, arabic bigint, ended bigint, n_lines bigint, n_chars bigint"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        s = line_statistics(b.column("text"), b.column("furniture"))
        ls, keep = s["start"], s["keep"]
        doc = np.repeat(np.arange(b.num_rows), np.diff(ls))
        begin = np.zeros(b.num_rows + 1, np.int64)
        np.cumsum(np.bincount(doc[keep], minlength=b.num_rows), out=begin[1:])
        total = lambda x: pa.array(np.bincount(doc, np.asarray(x, float), b.num_rows).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), lists(s["code"][keep].astype(np.int32), begin, pa.int32()), lists(s["chars"][keep].astype(np.int32), begin, pa.int32())]
            + [total(s[c]) for c in ("words", "letters", "common", "symbols", "arabic", "ended")]
            + [total(s["chars"] > 0), total(s["chars"])],
            names=[x.split()[0] for x in SEQUENCES.split(", ")],
        )


def sequences(build: DataFrame, frequent: DataFrame) -> DataFrame:
    """One row per row of build with a uid: its lines' codes and sizes and its counts, cut from the lineage."""
    rows = attach(build, frequent).select("uid", "text", "furniture").where("uid is not null")
    return cut(rows.mapInArrow(_sequences, SEQUENCES))


def unpack(code: np.ndarray) -> list[np.ndarray]:
    out = []
    for b in reversed(BINS):
        out.append(code % b)
        code = code // b
    return out[::-1]


class Model:
    def __init__(self) -> None:
        self.emit = [np.array(t, float) for t in PRIOR]
        self.first = np.array(FIRST)
        k = len(STATES)
        self.move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(self.move, STAY)

    def run(self, codes_: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.ones((len(codes_), len(STATES)))
        for t, x in zip(self.emit, unpack(codes_), strict=True):
            score *= t[:, x].T
        post, moves, _ = forward_backward(score, start, self.first, self.move)
        return post, moves

    def count(self, codes_: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Expected counts of firsts, moves and emissions in one vector."""
        post, moves = self.run(codes_, start)
        first = post[start[:-1][np.diff(start) > 0]].sum(0)
        emit = [np.stack([np.bincount(x, post[:, s], b) for s in range(len(STATES))]) for x, b in zip(unpack(codes_), BINS, strict=True)]
        return np.concatenate([first, moves.ravel(), *(e.ravel() for e in emit)])

    def update(self, v: np.ndarray, weight: float = 50.0) -> None:
        """New tables from expected counts; the prior tables count as so many lines."""
        k, base = len(STATES), Model()
        self.first = v[:k] + weight * base.first
        self.first /= self.first.sum()
        self.move = v[k : k + k * k].reshape(k, k) + weight * base.move
        self.move /= self.move.sum(1, keepdims=True)
        at = k + k * k
        for i, b in enumerate(BINS):
            t = v[at : at + k * b].reshape(k, b) + weight * base.emit[i]
            self.emit[i] = t / t.sum(1, keepdims=True)
            at += k * b


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    start = np.zeros(len(col) + 1, np.int64)
    np.cumsum(np.asarray(col.value_lengths().fill_null(0), np.int64), out=start[1:])
    return np.asarray(col.flatten(), np.int64), start


def train(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over all rows; only the counts, a vector of fixed length, come to the driver."""
    model = Model()
    size = len(model.count(np.zeros(1, np.int64), np.array([0, 1])))
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            v = np.zeros(size)
            for b in batches:
                c, s = _flat(b.column("codes"))
                if len(c):
                    v += now.value.count(c, s)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(v)], names=["i", "v"])

        got = rows.select("codes").mapInArrow(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(size)
        for r in got:
            v[r["i"]] = r["v"]
        model.update(v)
    return model


def labelled(rows: DataFrame, model: Model) -> DataFrame:
    """rows with prose, list, table and junk: each state's share of the characters (null without a line)."""
    now = rows.sparkSession.sparkContext.broadcast(model)
    kept = [x for x in SEQUENCES.split(", ") if "array" not in x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, s = _flat(b.column("codes"))
            size = _flat(b.column("chars"))[0].astype(float)
            shares = np.zeros((b.num_rows, len(STATES)))
            if len(c):
                best = now.value.run(c, s)[0].argmax(1)
                doc = np.repeat(np.arange(b.num_rows), np.diff(s))
                np.add.at(shares, (doc, best), size)
            total = shares.sum(1)
            none = total == 0
            shares = shares / np.where(none, 1, total)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(x.split()[0]) for x in kept] + [pa.array(shares[:, i], mask=none) for i in range(len(STATES))], names=[x.split()[0] for x in kept] + list(STATES))

    return rows.mapInArrow(run, ", ".join(kept + [f"{s} double" for s in STATES]))


def statistics(build: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per row of build: counts, ratios and line label shares."""
    rows = sequences(build, frequent)
    r = labelled(rows, train(rows))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    return r.select(
        "uid", "n_chars", "n_words", "n_lines", ratio("letters", "n_words").alias("mean_word_length"), ratio("symbols", "n_chars").alias("symbol_ratio"),
        ratio("arabic", "n_chars").alias("script_fraction"), ratio("ended", "n_lines").alias("ended_line_share"), ratio("common", "n_words").alias("common_word_share"),
        *(F.round(F.col(s), 4).alias(f"{s}_share") for s in STATES),
    )


def not_prose(build: DataFrame, frequent: DataFrame) -> DataFrame:
    """(uid) of records whose text as a whole is a list, a table or junk."""
    rows = sequences(build, frequent)
    return labelled(rows, train(rows)).where(F.col("prose") < PROSE_SHARE).select("uid").distinct()
