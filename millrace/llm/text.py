"""Arrow batches of text as code-point arrays: folding, words and lines without a Python loop over characters.

"Apart from spelling" means here: invisible characters, marks, kashida, case, digit script and the Arabic/Urdu forms
of yeh, kaf and heh don't count, and neither do spacing and punctuation, which only separate words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, NEWLINE, DROP = 32, 10, 0
CHUNK_BYTES = 3 << 20

# Letters that count as one letter.
SAME_LETTER = {"ي": "ی", "ى": "ی", "ك": "ک", "ه": "ہ", "ھ": "ہ", "ە": "ہ"}


@cache
def fold_table() -> np.ndarray:
    """Code point -> folded code point; DROP for what doesn't count, SPACE for separators, NEWLINE kept."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if c == NEWLINE:
            continue
        if ch == "ـ" or kind in ("Mn", "Me", "Mc", "Cf") and not 0x0600 <= c <= 0x0605:
            out[c] = DROP
        elif kind[0] == "L" or kind == "Nd":
            x = unicodedata.normalize("NFKD", ch).casefold()
            x = next((y for y in x if unicodedata.category(y)[0] in "LN"), ch)
            if unicodedata.category(x) == "Nd":
                x = str(unicodedata.digit(x))
            out[c] = ord(SAME_LETTER.get(x, x))
        else:
            out[c] = SPACE
    out[0x1F000:0x1FB00] = SPACE
    out[0xE0000:0xE0200] = DROP
    out[0xF0000:] = SPACE
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low bits of sums are spread."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 4096), BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def codes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts (one more at the end). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    raw = bytes(memoryview(data)[off[0] : off[-1]]) if data is not None else b""
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=at[1:])
    return cp, at[off - off[0]]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most about so many bytes of text (a longer text comes alone), so that arrays stay small."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(column)
        size = np.asarray(pc.binary_length(col).fill_null(0), np.int64)
        ends = np.cumsum(size)
        lo = 0
        while lo < n:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Words:
    """The words of a batch: folded hash, first and last+1 code point, line, and where each text's words start."""

    hash: np.ndarray
    first: np.ndarray
    end: np.ndarray
    line: np.ndarray
    start: np.ndarray
    folded: np.ndarray
    fold_first: np.ndarray
    fold_end: np.ndarray


def line_numbers(cp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per code point, the number of line breaks before it in its text."""
    nl = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(cp == NEWLINE, out=nl[1:])
    doc = np.repeat(start[:-1], np.diff(start))
    return nl[:-1] - nl[doc]


def words(cp: np.ndarray, start: np.ndarray, lines: bool = False, table: np.ndarray | None = None) -> Words:
    """The words of a batch under the folding table (or another table of the same kind)."""
    f = (fold_table() if table is None else table)[cp]
    keep = np.flatnonzero(f)
    g = f[keep]
    is_word = g > SPACE
    begins = np.zeros(len(g) + 1, bool)
    begins[np.searchsorted(keep, start)] = True
    prev = np.empty(len(g), bool)
    if len(g):
        prev[0] = False
        prev[1:] = is_word[:-1]
    firsts = np.flatnonzero(is_word & (~prev | begins[:-1]))
    pos = np.flatnonzero(is_word)
    if not len(firsts):
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, z, np.zeros(len(start), np.int64), g, z, z)
    at = np.searchsorted(pos, firsts)
    sizes = np.diff(np.append(at, len(pos)))
    k = np.arange(len(pos)) - np.repeat(at, sizes)
    top = int(sizes.max())
    h = mix(np.add.reduceat((g[pos].astype(np.uint64) + np.uint64(0x1234567)) * powers(top)[k], at))
    last = pos[at + sizes - 1]
    first_cp = keep[firsts]
    w_start = np.searchsorted(first_cp, start)
    line = line_numbers(cp, start)[first_cp] if lines else np.zeros(0, np.int64)
    return Words(h, first_cp, keep[last] + 1, line, w_start, g, firsts, last + 1)


def line_keys(cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line's letters alone (0 where it has none), and where each text's lines start."""
    n = len(start) - 1
    nl = np.flatnonzero(cp == NEWLINE)
    doc_of = np.searchsorted(start, nl, "right") - 1
    per = np.bincount(doc_of, minlength=n)[:n] + 1
    l_start = np.zeros(n + 1, np.int64)
    np.cumsum(per, out=l_start[1:])
    f = fold_table()[cp]
    letter = (f > SPACE) & ~((f >= 48) & (f <= 57))
    pos = np.flatnonzero(letter)
    breaks = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(cp == NEWLINE, out=breaks[1:])
    doc = np.searchsorted(start, pos, "right") - 1
    line = l_start[doc] + breaks[pos] - breaks[start[doc]]
    out = np.zeros(l_start[-1], np.uint64)
    if len(pos):
        at = np.flatnonzero(np.diff(line, prepend=-1))
        sizes = np.diff(np.append(at, len(pos)))
        k = np.arange(len(pos)) - np.repeat(at, sizes)
        h = mix(np.add.reduceat((f[pos].astype(np.uint64) + np.uint64(0x7654321)) * powers(int(sizes.max()))[k], at))
        out[line[at]] = np.maximum(h, np.uint64(1))
    return out, l_start


def lists(values: np.ndarray, start: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values cut at start as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(values, kind))


def folded_words(text: str) -> list[str]:
    """The folded words of one text (for small sides and tests)."""
    cp, start = codes(pa.array([text]))
    w = words(cp, start)
    s = w.folded.tobytes().decode("utf-32-le", "replace")
    return [s[a:b] for a, b in zip(w.fold_first.tolist(), w.fold_end.tolist(), strict=True)]
