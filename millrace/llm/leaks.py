"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over folded words.

The patterns are all runs of RUN consecutive words of every test item. A window of RUN words slides over a text; the
block of its last BLOCK words is looked up in a shift table, which says how far the window can move without missing a
pattern; at shift 0 the suffix-hash bucket of the block gives the patterns to compare word by word. All texts of a
batch move at once. Items shorter than RUN words have no pattern. Null and empty texts hold nothing.

The items are read to the driver in blocks of BLOCK_WORDS words (the test items are a stated, fixed set); the corpus is
searched once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import BASE, chunks, codes, words

RUN, BLOCK = 14, 2
BLOCK_WORDS = 2_000_000


class WuManber:
    def __init__(self, items: list[tuple[int, np.ndarray]], run: int = RUN):
        self.run = run
        blocks, shifts, starts = [], [], []
        whole, owner, offset = [], [], []
        for item, h in items:
            n = len(h) - run + 1
            if n < 1:
                continue
            b = self.block(h)
            last = np.arange(len(b))
            # In some window the block ends as late as it can: it is shifted over by what lies between.
            blocks.append(b)
            shifts.append(np.maximum(0, run - BLOCK - last))
            starts.append(b[run - BLOCK :])
            whole.append(np.lib.stride_tricks.sliding_window_view(h, run))
            owner.append(np.full(n, item))
            offset.append(np.arange(n))
        self.most = run - BLOCK + 1
        self.empty = not blocks
        if self.empty:
            return
        b, s = np.concatenate(blocks), np.concatenate(shifts)
        order = np.lexsort((s, b))
        self.blocks, first = np.unique(b[order], return_index=True)
        self.shifts = s[order][first]
        end, self.windows, self.owner = np.concatenate(starts), np.concatenate(whole), np.concatenate(owner)
        order = np.argsort(end, kind="stable")
        self.windows, self.owner = self.windows[order], self.owner[order]
        self.ends, self.bucket = np.unique(end[order], return_index=True)
        self.bucket = np.append(self.bucket, len(end))

    @staticmethod
    def block(h: np.ndarray) -> np.ndarray:
        return h[:-1] * np.uint64(BASE) + h[1:]

    def search(self, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) for each occurrence in a batch of texts."""
        docs, items = [], []
        if self.empty or len(h) < self.run:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        b = self.block(h)
        doc = np.flatnonzero(np.diff(start) >= self.run)
        at, stop = start[doc] + self.run - BLOCK, start[doc + 1] - BLOCK + 1
        while len(doc):
            x = b[at]
            k = np.minimum(np.searchsorted(self.blocks, x), len(self.blocks) - 1)
            shift = np.where(self.blocks[k] == x, self.shifts[k], self.most)
            for i in np.flatnonzero(shift == 0).tolist():
                e = np.searchsorted(self.ends, x[i])
                if e < len(self.ends) and self.ends[e] == x[i]:
                    lo, hi = self.bucket[e], self.bucket[e + 1]
                    p = at[i] + BLOCK - self.run
                    hit = (self.windows[lo:hi] == h[p : p + self.run]).all(1)
                    if hit.any():
                        own = np.unique(self.owner[lo:hi][hit])
                        docs.append(np.full(len(own), doc[i]))
                        items.append(own)
            at = at + np.maximum(shift, 1)
            go = at < stop
            doc, at, stop = doc[go], at[go], stop[go]
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(docs), np.concatenate(items)


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    cp, start = codes(pa.array(texts, pa.string()))
    w = words(cp, start)
    return [w.hash[a:b] for a, b in zip(w.start[:-1].tolist(), w.start[1:].tolist(), strict=True)]


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id), distinct: the text holds at least run consecutive words of the item."""
    blocks: list[list[tuple[int, np.ndarray]]] = [[]]
    size = 0
    for r in items.select(item, "text").where(f"{item} is not null and text is not null").toLocalIterator():
        h = hashed([r["text"]])[0]
        if size and size + len(h) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((r[item], h))
        size += len(h)
    out = None
    texts = documents.select(doc, "text").where(f"{doc} is not null and text is not null")
    for block in blocks:
        searcher = documents.sparkSession.sparkContext.broadcast(WuManber(block, run))

        def find(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                w = words(*codes(b.column("text")))
                docs, found = searcher.value.search(w.hash, w.start)
                if len(docs):
                    yield pa.RecordBatch.from_arrays([b.column(doc).take(pa.array(docs)), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

        part = texts.mapInArrow(find, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
