"""Encoding with given vocabularies: adapters, byte spans, merge-rank and Viterbi encoders. Nothing is trained here.

An adapter is a picklable factory that returns encode(text) -> ids in the worker. Vocabulary files are read from a path
that the caller gives (by default the installed public ones); they are never copied.
"""

from __future__ import annotations

import base64
import heapq
import importlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ADAPTERS: dict[str, Callable[[str | None], Callable[[list[str]], list[list[int]]]]] = {}


def adapter(name: str):
    """Register a factory: path or None -> (texts -> ids)."""

    def add(f):
        ADAPTERS[name] = f
        return f

    return add


def factory(name: str):
    """A registered factory, or one named as module:factory."""
    if ":" in name:
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)
    return ADAPTERS[name]


def default_path(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@adapter("byte_bpe")
def byte_bpe(path: str | None = None):
    import public_tokenizers
    import tiktoken

    e = tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path or default_path("byte_bpe_50k.tiktoken")), special_tokens={})
    return lambda texts: [e.encode_ordinary(t) for t in texts]


@adapter("byte_bpe_multi")
def byte_bpe_multi(path: str | None = None):
    return byte_bpe(path or default_path("byte_bpe_multi_50k.tiktoken"))


@adapter("piece_bpe")
def piece_bpe(path: str | None = None):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or default_path("piece_bpe_32k.model"))
    return lambda texts: p.encode(texts, num_threads=1)


@adapter("utf8_bytes")
def utf8_bytes(path: str | None = None):
    return lambda texts: [list(t.encode()) for t in texts]


def encoded(df: DataFrame, key: str, text: str, name: str, path: str | None = None) -> DataFrame:
    """(key, ids) for every row; null texts give null."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory(name)(path)
        for b in batches:
            t = b.column(text).to_pylist()
            ids = encode([x or "" for x in t])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([None if x is None else y for x, y in zip(t, ids, strict=True)], pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def merge_ranks(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding of one piece: always the adjacent pair of least rank, leftmost first; a heap holds the pairs
    and stale entries are skipped."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(table[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = nxt[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        nxt[i] = nxt[j]
        if nxt[i] < len(parts):
            prv[nxt[i]] = i
        for a in (prv[i], i):
            if a >= 0 and parts[a] is not None and nxt[a] < len(parts):
                both = parts[a] + parts[nxt[a]]
                if both in table:
                    heapq.heappush(heap, (table[both], a, both))
    return [table[p] for p in parts if p is not None]


def viterbi(text: str, scores: dict[str, float], unknown: float = -100.0) -> list[str]:
    """The best-scoring split into pieces; of equal paths the first found in a left-to-right scan. A character outside
    the table stands alone at the unknown score."""
    n = len(text)
    best = [-np.inf] * (n + 1)
    back = [0] * (n + 1)
    best[0] = 0.0
    longest = max((len(p) for p in scores), default=1)
    for i in range(n):
        if best[i] == -np.inf:
            continue
        for j in range(i + 1, min(n, i + longest) + 1):
            s = scores.get(text[i:j], unknown if j == i + 1 else None)
            if s is not None and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    out, j = [], n
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


def byte_spans(pieces: list[bytes]) -> list[tuple[int, int]]:
    """Where each token's bytes lie in the text."""
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True)) if pieces else []


def lossy(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, lossless): whether a text's tokens' bytes give the text again, span after span."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        back = {v: k for k, v in ranks(path or default_path("byte_bpe_50k.tiktoken")).items()}
        for b in batches:
            t = [x or "" for x in b.column(text).to_pylist()]
            ok = []
            for x, ids in zip(t, encode(t), strict=True):
                pieces = [back[i] for i in ids]
                spans = byte_spans(pieces)
                ok.append(b"".join(pieces) == x.encode() and (not spans or spans[-1][1] == len(x.encode())))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ok)], names=[key, "lossless"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, lossless boolean")
