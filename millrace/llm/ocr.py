"""Noise in text from scanned pages: find broken words, misread words, running titles and page numbers; repair them.

Records that look scanned (lines wrapped at the page's width, words broken at line ends, page numbers, or said so by
extraction_method) are held apart from the others, whose words, counted over all records, form the lexicon. A word of
a scanned record is suspect when it is missing from the lexicon or far rarer there than in scans. Candidates come from
a symmetric-delete index: suspects and lexicon words meet in the strings that remain when letters are deleted, by one
equi-join. A weighted edit distance, cheaper for known confusions, orders the candidates; for a repair, counts of the
neighbouring word pairs and the word's frequency decide among them. A suspect with a candidate, or with a symbol or
digit between letters, is a misread word.

Null and empty texts have no damage; repeated rows of a uid give the same rows (results are distinct; a repaired text is that of the least row); lists, tables
and junk (few common words) and web records are out of scope.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded
from .pii import _names, find
from .quality import common_words
from .text import BASE, DROP, NEWLINE, SPACE, Words, chunks, codes, fold_table, mix, words

SOURCES = ("book", "newspaper")
#: A word is known if its rate in clean records is at least this share of its rate in scanned ones.
KNOWN = 0.05
#: Least clean count of a candidate.
SUPPORT = 3
#: Texts with a smaller share of common words are lists, tables or junk.
RUNNING = 0.3
#: The same for texts that extraction_method says are scans: heavy damage hides common words.
RUNNING_SAID = 0.2
SAID = r"ocr|tesseract"
HYPHENS = "-­¬‐"

# Shapes that recognition confuses, each pair in both directions.
CONFUSED = {
    frozenset(p)
    for p in ("ا1", "اl", "اI", "و9", "ہ5", "ہھ", "یى", "یب", "مص", "سش", "جخ", "جح", "رز", "رڑ", "ور", "نز", "نت", "بٮ", "بپ", "تث", "تٹ", "دذ", "کگ", "لک", "لا", "آا", "ٹت", "o0", "l1", "lI", "ec", "un", "tf", "rn", "iI")
}
CLUSTERS = (("rn", "m"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("vv", "w"))


@cache
def strict_table() -> np.ndarray:
    """Like the folding table, but symbols inside words count and only Arabic keyboard forms are made one letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    out[fold_table() == DROP] = DROP
    for c in range(0x10000):
        ch = chr(c)
        k = unicodedata.category(ch)
        if out[c] == DROP:
            continue
        if c == NEWLINE:
            out[c] = NEWLINE
        elif k == "Nd":
            out[c] = 48 + unicodedata.digit(ch)
        elif k[0] in "LNS" and ch not in "¬|+=<>" or ch == "@":
            out[c] = c
    for a, b in (("ي", "ی"), ("ك", "ک"), ("ه", "ہ")):
        out[ord(a)] = ord(b)
    return out


_PAGE = re.compile(r"\W*(?:صفحہ|صفحه|page|p\.?)?\W*[0-9٠-٩۰-۹lIoO]{0,3}[0-9٠-٩۰-۹][0-9٠-٩۰-۹lIoO]{0,3}(?:\s*/\s*\d{1,4})?\W*", re.I)
_BROKEN = re.compile(rf"[^\W_]ـ?[ً-ْ​-‏]*[{HYPHENS}]\s*$|[©~¦�§°][{HYPHENS}]\s*$")
_OPEN = re.compile(r"[.!?۔؟،:…*»)\]][\s.]*$")
_LETTER = re.compile(r"\s*[^\W\d_©]|\s*\w")


def line_kinds(lines: list[str], book: bool) -> tuple[list[str | None], list[bool], bool]:
    """Per line header, page_no or None, whether it ends in a broken word, and whether the text looks scanned."""
    kinds: list[str | None] = [None] * len(lines)
    broken = [False] * len(lines)
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for i in filled:
        x = lines[i].strip()
        if len(x) <= 20 and _PAGE.fullmatch(x):
            kinds[i] = "page_no"
    for i in filled:
        # A page's number may stand between the two parts of a broken word.
        n = i + 1
        while n < len(lines) and kinds[n] == "page_no":
            n += 1
        if kinds[i] is None and n < len(lines) and _BROKEN.search(lines[i]) and _LETTER.match(lines[n]):
            broken[i] = True
    open_ = sum(1 for i in filled if not _OPEN.search(lines[i]))
    wrapped = len(lines) >= 3 and 2 * open_ >= len(filled) and max((len(lines[i]) for i in filled), default=0) <= 100
    scanned = wrapped or any(broken) or "page_no" in kinds
    if book:
        # A running title: few words, none of them common, no end of a sentence; with a number or on a scanned page.
        for i in filled:
            x = lines[i]
            if kinds[i] is None and len(x) <= 60 and not broken[i] and not re.search(r"[.!?۔؟،:]\s*$", x):
                w = re.findall(r"[^\W\d_][^\s\[\]|]*", x)
                number = re.search(r"(?:^|[\s\[(«])[0-9٠-٩۰-۹]{1,4}(?:$|[\s\])»])", x)
                if 2 <= len(w) <= 4 and (number or scanned) and not (i and broken[i - 1]) and not _common(w):
                    kinds[i] = "header"
                    scanned = scanned or bool(number)
    return kinds, broken, scanned


def _common(ws: list[str]) -> bool:
    cp, start = codes(pa.array([" ".join(ws)]))
    return bool(np.isin(words(cp, start).hash, common_words()).any())


def _running(b: pa.RecordBatch, cp: np.ndarray, start: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Which texts are running language: enough common words (fewer, where a scan is said to be one)."""
    w = words(cp, start)
    n = np.diff(w.start)
    doc = np.repeat(np.arange(b.num_rows), n)
    return np.bincount(doc, np.isin(w.hash, common_words()), b.num_rows) >= np.where(said, RUNNING_SAID, RUNNING) * np.maximum(n, 1)


def _scanned(b: pa.RecordBatch, cp: np.ndarray, start: np.ndarray) -> dict[int, tuple[list[str], list[str | None], list[bool]]]:
    """The scanned-looking texts of a batch: lines, kinds, broken."""
    out = {}
    said = np.array([bool(re.search(SAID, x or "", re.I)) for x in b.column("extraction_method").to_pylist()], bool)
    ok = _running(b, cp, start, said)
    for i, s in enumerate(b.column("source").to_pylist()):
        if s in SOURCES and ok[i]:
            lines = b.column("text")[i].as_py().split("\n")
            kinds, broken, scanned = line_kinds(lines, s == "book")
            if scanned or said[i]:
                out[i] = lines, kinds, broken
    return out


def _spell(w: Words, i: int) -> str:
    return w.folded[w.fold_first[i] : w.fold_end[i]].tobytes().decode("utf-32-le", "replace")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        cp, start = codes(b.column("text"))
        scan = np.zeros(b.num_rows, np.int64)
        got = _scanned(b, cp, start)
        scan[list(got)] = 1
        w = words(cp, start, lines=True, table=strict_table())
        if not len(w.hash):
            continue
        # Running titles repeat page after page and would make their words look like words of scans only.
        weight = np.ones(len(w.hash))
        for d, (_, kinds, _) in got.items():
            aside = [n for n, k in enumerate(kinds) if k]
            if aside:
                lo, hi = w.start[d], w.start[d + 1]
                weight[lo:hi] = ~np.isin(w.line[lo:hi], aside)
        h, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        in_scan = np.bincount(which, np.repeat(scan, np.diff(w.start)) * weight, len(h)).astype(np.int64)
        total = np.bincount(which, weight, len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_spell(w, i) for i in first.tolist()], pa.string()), pa.array(total - in_scan), pa.array(in_scan)], names=["word", "clean", "scan"])


INPUT = ("uid", "text", "source", "extraction_method")


def lexicon(build: DataFrame) -> DataFrame:
    """(word, clean, scan): how often each word occurs in clean and in scanned-looking records, cut."""
    rows = build.select(*INPUT).where("text is not null").mapInArrow(_count, "word string, clean bigint, scan bigint")
    return cut(rows.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan")))


#: Words of more letters have too many deletions; they are met in their thirds.
LONG = 40


def thirds(w: str, suspect: bool) -> list[str]:
    """What long words within distance 2 meet in: of three parts at least one is whole, at most two letters off its place.
    The known word has its own three parts, the suspect every place where such a part may lie."""
    out = set()
    for n in range(len(w) - 2, len(w) + 3) if suspect else (len(w),):
        if n <= LONG:
            continue
        for i in range(3):
            a, b = i * n // 3, (i + 1) * n // 3
            for shift in range(-2, 3) if suspect else (0,):
                if 0 <= a + shift and b + shift <= len(w):
                    out.add(f"{n}:{i}:{w[a + shift : b + shift]}")
    return sorted(out)


def deletes(w: str, most: int = 2, suspect: bool = True) -> list[str]:
    """The word and what remains of it with one letter deleted, of longer words with two, and with shapes that two
    letters share written as one; thirds() of words of more than LONG letters."""
    far = thirds(w, suspect) if len(w) > LONG - 2 else []
    if len(w) > LONG + 2:
        return far
    out = {w}
    for a, b in CLUSTERS:
        if a in w:
            out |= {w.replace(a, b, 1)}
    near = set(out)
    for _ in range(most if len(w) >= 7 else 1):
        near = {x[:i] + x[i + 1 :] for x in near for i in range(len(x))}
        out |= near
    return sorted([*(x for x in out if x), *far])


def distance(a: str, b: str) -> float:
    """Edit distance in which a known confusion costs less."""
    for x, y in CLUSTERS:
        if x in a and a.replace(x, y, 1) == b or x in b and b.replace(x, y, 1) == a:
            return 0.5
    prev = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            same = 0.0 if x == y else 0.5 if frozenset((x, y)) in CONFUSED or not x.isalpha() else 1.0
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + same))
        prev = row
    return prev[-1]


def _deletes(suspect: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            for i, w in enumerate(b.column("word").to_pylist()):
                d = deletes(w, suspect=suspect)
                keys += d
                at += [i] * len(d)
            yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(at, pa.int64())), b.column("clean").take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], names=["word", "clean", "key"])

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = [distance(x, y) for x, y in zip(b.column("word").to_pylist(), b.column("candidate").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("candidate"), b.column("clean"), pa.array(d)], names=["word", "candidate", "clean", "distance"])


def suspects(lex: DataFrame) -> DataFrame:
    """(word, odd): words of scans that the lexicon doesn't know; odd: with a symbol or digit between letters."""
    total = lex.agg(F.sum("clean"), F.sum("scan")).first()
    clean, scan = max(1, total[0] or 0), max(1, total[1] or 0)
    unknown = (F.col("scan") > 0) & (F.col("clean") * scan < KNOWN * F.col("scan") * clean)
    odd = F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"[^\p{L}]")
    mixed = F.col("word").rlike(r"[a-zA-Z]") & F.col("word").rlike(r"\p{InArabic}")
    return lex.where(unknown & F.col("word").rlike(r"[^\d]")).select("word", (odd | mixed).alias("odd"))


def candidates(lex: DataFrame, bad: DataFrame) -> DataFrame:
    """(word, candidate, clean, distance) of suspects, by the symmetric-delete index; at distance 1 or less, for longer
    words 1.5."""
    kind = "word string, clean bigint, key string"
    left = bad.select("word", F.lit(0).cast("bigint").alias("clean")).mapInArrow(_deletes(True), kind).select("word", "key")
    right = lex.where(F.col("clean") >= SUPPORT).join(bad, "word", "left_anti").where(~F.col("word").rlike(r"[^\p{L}]")).select("word", "clean").mapInArrow(_deletes(False), kind)
    near = F.abs(F.length("word") - F.length("candidate")) <= 2
    pairs = left.join(right.withColumnRenamed("word", "candidate"), "key").where(near).select("word", "candidate", "clean").distinct()
    got = pairs.mapInArrow(_weigh, "word string, candidate string, clean bigint, distance double")
    return got.where((F.col("distance") <= 1) | (F.col("distance") <= 1.5) & (F.length("word") >= 7))


TOKENS = "uid string, line_no int, kind string, word string, pos int, before bigint, after bigint, next int"


def _damage(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            cp, start = codes(b.column("text"))
            got = _scanned(b, cp, start)
            if not got:
                continue
            sub = b.take(pa.array(sorted(got)))
            cp, start = codes(sub.column("text"))
            w = words(cp, start, lines=True, table=strict_table())
            private = np.zeros(len(w.hash), bool)
            for row, _, lo, hi, _ in find(sub.column("text"), names):
                i, j = np.searchsorted(w.first, [start[row] + lo, start[row] + hi])
                private[i:j] = True
            uid = sub.column("uid").to_pylist()
            out: list[tuple] = []
            for d, (_, (_, kinds, broken)) in enumerate(sorted(got.items())):
                out += [(uid[d], i, k, None, None, None, None, None) for i, k in enumerate(kinds) if k]
                out += [(uid[d], i, "hyphen", None, None, None, None, None) for i, x in enumerate(broken) if x]
                lo, hi = int(w.start[d]), int(w.start[d + 1])
                line = w.line[lo:hi].tolist()
                skip = -1
                for k in range(lo, hi):
                    l = line[k - lo]
                    if private[k] or kinds[l] is not None or k <= skip:
                        continue
                    text, at = _spell(w, k), l
                    last = k + 1 == hi or line[k + 1 - lo] != l
                    follow = k + 1
                    while follow < hi and kinds[line[follow - lo]] == "page_no":
                        follow += 1
                    if last and broken[l] and follow < hi and all(kinds[x] == "page_no" for x in range(l + 1, line[follow - lo])):
                        # A broken word counts whole; where it is damaged is decided when it is compared.
                        text += "\n" + _spell(w, follow)
                        skip = follow
                    if text.isdigit():
                        continue
                    before = int(w.hash[k - 1].view(np.int64)) if k > lo else 0
                    after = int(w.hash[k + 1].view(np.int64)) if k + 1 < hi and skip <= k else 0
                    out.append((uid[d], at, "word", text, int(w.first[k] - start[d]), before, after, line[skip - lo] if skip > k else None))
            if out:
                c = list(zip(*out, strict=True))
                kinds_ = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(c, kinds_, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

    return run


def scan_rows(build: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per structural damage and per word of the scanned-looking records."""
    rows = build.select(*INPUT).where(F.col("source").isin(*SOURCES) & F.col("text").isNotNull() & F.col("uid").isNotNull())
    return rows.mapInArrow(_damage(_names(parts)), TOKENS)


def analyse(build: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(damage rows with whole words, suspects with their candidates, lexicon), each cut."""
    lex = lexicon(build)
    raw = cut(scan_rows(build, parts).distinct())
    rows = raw.withColumn("whole", F.replace("word", F.lit("\n"), F.lit("")))
    # Words broken at a line's end aren't in the lexicon's count of whole words; they are judged like the others.
    joined = rows.where(F.col("word").contains("\n")).groupBy(F.col("whole").alias("word")).agg(F.count("*").alias("more"))
    lex = cut(lex.join(joined, "word", "full").select("word", F.coalesce("clean", F.lit(0)).alias("clean"), (F.coalesce("scan", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("scan")))
    bad = cut(suspects(lex))
    cand = cut(candidates(lex, bad))
    return rows, bad.join(cand.groupBy("word").agg(F.min(F.struct("distance", (-F.col("clean")).alias("rare"), "candidate")).alias("best")), "word", "left").where("odd or best is not null"), cand


def found(build: DataFrame, parts: DataFrame) -> DataFrame:
    """(uid, line_no, kind), distinct: damaged lines."""
    rows, bad, _ = analyse(build, parts)
    structural = rows.where("kind <> 'word'").select("uid", "line_no", "kind")
    hit = rows.where("kind = 'word'").join(bounded(cut(bad.select(F.col("word").alias("whole"), F.col("best.candidate").alias("candidate")))), "whole")
    # In a broken word the damage lies before or after the break: the first part is intact if the candidate begins with it.
    first = F.substring_index("word", "\n", 1)
    second = F.col("word").contains("\n") & F.when(F.col("candidate").isNotNull(), F.col("candidate").startswith(first)).otherwise(~first.rlike(r"[^\p{L}]"))
    misread = hit.select("uid", F.when(second, F.col("next")).otherwise(F.col("line_no")).alias("line_no"), F.lit("ocr_char").alias("kind"))
    return structural.unionByName(misread).distinct()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        w = words(*codes(b.column("text")), table=strict_table())
        if len(w.hash) < 2:
            continue
        h = mix(w.hash[:-1] * np.uint64(BASE) + w.hash[1:])
        inner = np.ones(len(h), bool)
        edge = w.start[1:-1] - 1
        inner[edge[(edge >= 0) & (edge < len(h))]] = False
        k, n = np.unique(h[inner], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cand = b.column("candidate").to_pylist()
        w = words(*codes(pa.array(cand, pa.string())), table=strict_table())
        h = w.hash[w.start[:-1]]
        before, after = (np.asarray(b.column(c), np.int64).view(np.uint64) for c in ("before", "after"))
        left, right = mix(before * np.uint64(BASE) + h), mix(h * np.uint64(BASE) + after)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "line_no", "pos", "word", "candidate", "distance", "clean")), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["uid", "line_no", "pos", "word", "candidate", "distance", "clean", "left", "right"])


def corrections(build: DataFrame, parts: DataFrame) -> DataFrame:
    """(uid, line_no, pos, word, correction): for every misread word the candidate that its neighbours favour most:
    least distance minus the logarithm of pair counts and frequency, ties by spelling."""
    rows, bad, cand = analyse(build, parts)
    at = rows.where("kind = 'word'").withColumnRenamed("word", "seen").withColumnRenamed("whole", "word")
    opts = at.join(bounded(cand), "word").select("uid", "line_no", "pos", F.col("seen").alias("word"), "candidate", "distance", "clean", "before", "after")
    opts = cut(opts.mapInArrow(_context, "uid string, line_no int, pos int, word string, candidate string, distance double, clean bigint, left bigint, right bigint"))
    need = cut(opts.select(F.explode(F.array("left", "right")).alias("pair")).distinct())
    pairs = build.select("text").where("text is not null").mapInArrow(_pairs, "pair bigint, n bigint").join(bounded(need), "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("n"))
    l, r = pairs.select(F.col("pair").alias("left"), F.col("n").alias("n_left")), pairs.select(F.col("pair").alias("right"), F.col("n").alias("n_right"))
    known = opts.join(l, "left", "left").join(r, "right", "left")
    score = 4 * F.col("distance") - F.log1p(F.coalesce("n_left", F.lit(0))) - F.log1p(F.coalesce("n_right", F.lit(0))) - 0.5 * F.log1p("clean")
    return known.groupBy("uid", "line_no", "pos", "word").agg(F.min_by("candidate", F.struct(F.round(score, 9), "candidate")).alias("correction"))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        cp, start = codes(b.column("text"))
        got = _scanned(b, cp, start)
        out = b.column("text").to_pylist()
        fixes = b.column("fixes").to_pylist()
        for i, (lines, kinds, broken) in got.items():
            text = out[i]
            swap: dict[int, list[tuple[int, str, str]]] = {}
            for f in fixes[i] or ():
                swap.setdefault(f["line_no"], []).append((f["pos"], f["word"], f["correction"]))
            at, paragraphs, joined = 0, [""], False
            for n, line in enumerate(lines):
                here = line
                for pos, seen, right in sorted(swap.get(n, ()), reverse=True):
                    head = seen.split("\n")[0]
                    lo = pos - at
                    # Rows of one uid may differ in text against the rule; a repair then holds for its own row only.
                    if not 0 <= lo < len(here) or head and strict_table()[ord(here[lo])] != ord(head[0]):
                        continue
                    hi = lo
                    while hi < len(here) and not here[hi].isspace() and here[hi] not in "۔،؟!.,:;":
                        hi += 1
                    if "\n" in seen:
                        here = here[:lo] + right + "\n"
                    elif head:
                        here = here[:lo] + right + here[hi:]
                at += len(line) + 1
                if kinds[n] is not None:
                    continue
                if joined:
                    here = re.sub(r"^\s*\S+", "", here, count=1) if joined == "fixed" else here.lstrip()
                if not here.strip() and not joined:
                    paragraphs.append("")
                    continue
                glue = "" if joined == "raw" or not paragraphs[-1] else " "
                body = here.rstrip("\n")
                joined = False
                if broken[n]:
                    joined = "fixed" if here.endswith("\n") else "raw"
                    if joined == "raw":
                        body = body.rstrip().rstrip(HYPHENS)
                paragraphs[-1] += glue + body.strip()
            text = "\n".join(x for x in paragraphs if x)
            out[i] = text
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out, pa.string())], names=["uid", "text"])


def repair(build: DataFrame, parts: DataFrame) -> DataFrame:
    """(uid, text), one row per uid: scanned texts as continuous paragraphs with their repairs, others as they are."""
    fixes = corrections(build, parts).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("line_no", "pos", "word", "correction"))).alias("fixes"))
    one = build.where("uid is not null").groupBy("uid").agg(F.min(F.struct("text", "source", "extraction_method")).alias("r")).select("uid", "r.*")
    return one.join(fixes, "uid", "left").mapInArrow(_rewrite, "uid string, text string")
