"""Personal information inside free text: find, validate and replace by typed, linkable placeholders.

E-mail addresses, phone numbers, identity numbers, postal addresses and persons' names are found on a lightly
normalised copy of the text (invisible characters, marks and kashida dropped, digits made ASCII, letter forms of yeh,
kaf and heh made one) with a map back to the original offsets. Numbers are validated (form, region, codes) and their own
digits permuted by a keyed Feistel network within the form they are typed in, codes kept, so that equal numbers, however
typed, get the same digits in every document; labelled dates of birth become other days; the other kinds get a short
keyed digest. Names are composed of the stems and endings
that the known name parts share, since the list of parts is incomplete.

Null and empty texts hold nothing and stay as they are. Text of any length is processed whole; repeated rows give
repeated results (the found query makes them distinct); an empty name list finds no person.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import NEWLINE, SAME_LETTER, Words, chunks, codes, fold_table, words

KINDS = ("email", "phone", "id_number", "address", "person")


@cache
def light_table() -> np.ndarray:
    """Code point -> light form: 0 for what is dropped, a space for any space, ASCII digits, one form of a letter."""
    out = np.arange(0x110000, dtype=np.uint32)
    drop = fold_table() == 0
    out[drop] = 0
    for c in range(0x10000):
        ch = chr(c)
        if unicodedata.category(ch) == "Nd":
            out[c] = 48 + unicodedata.digit(ch)
        elif ch.isspace() and c != NEWLINE:
            out[c] = 32
    for a, b in SAME_LETTER.items():
        out[ord(a)] = ord(b)
    return out


def light(s: str) -> str:
    return "".join(chr(x) for x in light_table()[[ord(c) for c in s]] if x)


def _re(pattern: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile("".join(SAME_LETTER.get(c, c) for c in pattern), flags)


# The forms that contact data take.
_AT = r"(?: ?@ ?| ?[\[(] ?at ?[\])] ?| ایٹ )"
_DOT = r"(?:\.| \. | ?[\[(] ?dot ?[\])] ?| ڈاٹ )"
EMAIL = _re(rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)+", re.I)
_DASH = r"[- –.]"
PHONE = _re(
    r"(?<![\w+-])(?:"
    rf"(?:\+|00)92{_DASH}?\d{{3}}{_DASH}?\d{{7}}"
    rf"|\(0\d{{2,3}}\){_DASH}?\d{{3}}{_DASH}?\d\d{_DASH}?\d\d"
    rf"|0\d{{3}}{_DASH}\d{{3}}[ .]?\d{{3,4}}"
    r"|03\d{9}"
    rf"|\d{{6,7}}{_DASH}0\d{{3}}"
    r")(?![\w-]|\.\d)"
)
ID_NUMBER = _re(r"(?<![\w-])(?:\d{5}([-– ])\d{7}\1\d|\d([-– ])\d{7}\2\d{5}|(?!97[89])\d{13}|\d{3}-\d\d-\d{6})(?![\w-])")
_W = r"[^\s\d،,.۔:;<>()!؟?]+"
_WS = rf"{_W}(?: {_W}){{0,2}}"
_C = r" ?[،,]? ?"
_PLACE = rf"(?:{_C}{_W}(?: (?:کلاں|خورد|بالا|موڑا|سیری|والی|زریاب|سونڑاں|لوہاراں))?)?"
_LATIN = r"(?:,? ?[A-Z]\w+(?: [A-Z]\w+)?)?"
ADDRESS = _re(
    r"(?<!\w)(?:"
    rf"مکان(?: نمبر)? \d+{_C}گلی(?: نمبر)? \d+(?:{_C}محلہ {_WS})?{_PLACE}"
    rf"|محلہ {_WS}{_C}گلی(?: نمبر)? \d+(?:{_C}(?:گھار|گھر|مکان)(?: نمبر)? \d+)?{_PLACE}"
    rf"|ڈاکخانہ {_WS}{_C}(?:گراں|گاؤں) {_WS}{_C}(?:مکان|گھار|گھر)(?: نمبر)? \d+"
    rf"|کوٹھی(?: نمبر)? \d+{_C}{_WS} روڈ{_PLACE}"
    rf"|فلیٹ(?: نمبر)? \d+(?:-\d+)?{_C}{_WS} پلازہ{_PLACE}"
    rf"|House(?: No\.?)? \d+, ?Street(?: No\.?)? \d+(?:, ?Mohalla \w+)?{_LATIN}"
    rf"|H ?# ?\d+,? St ?# ?\d+{_LATIN}"
    rf"|Flat \d+(?:-\d+)?,? (?:\w+ ){{1,2}}Plaza{_LATIN}"
    r"|Village \w+(?: \w+)?, ?P\. ?O\. ?\w+(?: \w+)?, ?house \d+"
    rf"|\d+ (?:[A-Z]\w+ ){{1,2}}Road,{_LATIN}"
    r")"
)


#: A date of birth: the word for it, and a day in one of the usual orders. Only masked, and no case of found().
BIRTH = _re(r"(?<!\w)(?:تاریخ پیدائش|یوم پیدائش|تاریخ ولادت|date of birth|d\.?o\.?b\.?|born(?: on)?) ?:? ?(?P<date>\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d\d|(?:19|20)\d\d([-/.])\d{1,2}\3\d{1,2})(?!\d)", re.I)
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def valid(kind: str, raw: str) -> bool:
    """Whether a number that has the form of its kind can be one: an identity number's region is 0 to 7, a phone's code
    begins with 02 to 09, and neither is one digit again and again."""
    c, _ = canonical_digits(kind, raw) if kind in ("phone", "id_number") else (raw, [])
    if kind == "id_number":
        return len(set(c)) > 1 and (len(c) == 11 or c[0] in "01234567")
    if kind == "phone":
        return c[:1] == "0" and c[1] in "23456789" and len(set(c[4:])) > 1
    return True


def feistel(digits: str, key: bytes, rounds: int = 8) -> str:
    """A keyed permutation of the strings of so many digits (unbalanced halves swap, so any length works). One digit is
    shifted by a keyed amount."""
    n = len(digits)
    if n < 2:
        return "".join(str((int(d) + hmac.new(key, b"1", hashlib.sha256).digest()[0]) % 10) for d in digits)
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    wa, wb = u, n - u
    for r in range(rounds):
        f = int.from_bytes(hmac.new(key, f"{n}:{r}:{b}".encode(), hashlib.sha256).digest()[:8], "big")
        a, b = b, (a + f) % 10**wa
        wa, wb = wb, wa
    return f"{a:0{wa}d}{b:0{wb}d}"


def unfeistel(digits: str, key: bytes, rounds: int = 8) -> str:
    n = len(digits)
    if n < 2:
        return "".join(str((int(d) - hmac.new(key, b"1", hashlib.sha256).digest()[0]) % 10) for d in digits)
    u = n // 2
    wa, wb = (u, n - u) if rounds % 2 == 0 else (n - u, u)
    a, b = int(digits[:wa]), int(digits[wa:])
    for r in reversed(range(rounds)):
        wa, wb = wb, wa
        f = int.from_bytes(hmac.new(key, f"{n}:{r}:{a}".encode(), hashlib.sha256).digest()[:8], "big")
        a, b = (b - f) % 10**wa, a
    return f"{a:0{wa}d}{b:0{wb}d}"


def permuted_day(day: date, key: bytes) -> date:
    """A keyed permutation of the days from FIRST_DAY to LAST_DAY, by walking the cycle of a permutation of digits. A day
    outside stays."""
    n = (day - FIRST_DAY).days
    span = (LAST_DAY - FIRST_DAY).days + 1
    if not 0 <= n < span:
        return day
    width = len(str(span - 1))
    while True:
        n = int(feistel(f"{n:0{width}d}", key))
        if n < span:
            return FIRST_DAY + timedelta(n)


def canonical_digits(kind: str, raw: str) -> tuple[str, list[int]]:
    """A number's national digits in reading order, however it is typed, and for each digit typed its place among them
    (-1 for a digit of the country code)."""
    runs = re.findall(r"\d+", raw)
    d = "".join(runs)
    if kind == "phone":
        if len(runs) == 2 and len(runs[0]) >= 6 and runs[1].startswith("0"):
            n = len(runs[1])
            return runs[1] + runs[0], [*range(n, n + len(runs[0])), *range(n)]
        code = 4 if d.startswith("0092") else 2 if d.startswith("92") and len(d) > 11 else 0
        if code:
            return "0" + d[code:], [-1] * code + list(range(1, len(d) - code + 1))
    elif [len(x) for x in runs] == [1, 7, 5]:
        return "".join(reversed(runs)), [12, *range(5, 12), *range(5)]
    return d, list(range(len(d)))


def canonical(kind: str, raw: str) -> str:
    """One form of an item however it is typed: national digits in reading order, a lower-case address."""
    if kind == "email":
        s = re.sub(rf"{_AT}", "@", raw, flags=re.I)
        return re.sub(rf"{_DOT}", ".", s, flags=re.I).lower()
    if kind in ("phone", "id_number"):
        return canonical_digits(kind, raw)[0]
    return " ".join(re.findall(r"\w+", raw)).casefold()


def pseudonym(kind: str, raw: str, key: bytes) -> str:
    """What stands for an item. A number keeps its typed form, its country, operator or area code (phone) or region
    (identity number), and has its other digits permuted, so equal numbers agree in all digits however they are typed; a
    date of birth becomes another day typed alike; anything else becomes a keyed digest."""
    if kind == "date":
        parts = re.findall(r"\d+", raw)
        back = len(parts[0]) == 4
        y, m, d = (int(x) for x in (parts if back else parts[::-1]))
        try:
            day = permuted_day(date(y, m, d), hmac.new(key, b"date", hashlib.sha256).digest())
        except ValueError:
            return re.sub(r"\d", "0", raw)
        new = [day.year, day.month, day.day] if back else [day.day, day.month, day.year]
        it = iter(f"{n:0{len(p)}d}" for n, p in zip(new, parts, strict=True))
        return re.sub(r"\d+", lambda _: next(it), raw)
    if kind not in ("phone", "id_number"):
        return hmac.new(key, f"{kind}:{canonical(kind, raw)}".encode(), hashlib.sha256).hexdigest()[:8]
    c, place = canonical_digits(kind, raw)
    kept = 4 if kind == "phone" else 3 if len(c) == 11 else 1
    tweak = hmac.new(key, f"{kind}:{c[:kept]}".encode(), hashlib.sha256).digest()
    new = c[:kept] + feistel(c[kept:], tweak)
    it = iter(place)
    return re.sub(r"\d", lambda m: m[0] if (p := next(it)) < 0 else new[p], raw)


def placeholder(kind: str, raw: str, key: bytes) -> str:
    return f"<{kind.upper()}:{pseudonym(kind, raw, key)}>"


def secret(spark: SparkSession) -> bytes:
    """The key of the setting spark.millrace.pii.key, so that pseudonyms link runs. Without it, one of this session's
    own, drawn at random: pseudonyms then link the documents of the session only, and nobody can undo them."""
    given = spark.conf.get("spark.millrace.pii.key", None)
    if given:
        return given.encode()
    sc = spark.sparkContext
    if not hasattr(sc, "_millrace_pii_key"):
        sc._millrace_pii_key = secrets.token_bytes(32)
    return sc._millrace_pii_key


@dataclass
class Names:
    """Folded hashes (sorted) of given and family names, and the stems of each kind."""

    given: np.ndarray
    family: np.ndarray
    given_stems: tuple[str, ...]
    family_stems: tuple[str, ...]


def name_table(parts: list[tuple[str, str]]) -> Names:
    """The listed names and every stem with every ending of its kind and script. An ending is one that three names or
    more share, a stem one that takes two such endings or more and doesn't begin with a shorter stem."""
    known: dict[str, np.ndarray] = {}
    stems_of: dict[str, tuple[str, ...]] = {}
    for kind in ("given", "family"):
        every: set[str] = set()
        found: set[str] = set()
        for latin in (True, False):
            names = {fold_name(n) for n, k in parts if n and k == kind and n.isascii() == latin}
            ends, stems = defaultdict(set), defaultdict(set)
            for n in names:
                for i in range(2, len(n) - 1):
                    ends[n[i:]].add(n[:i])
            good = {e for e, s in ends.items() if len(s) >= 3}
            for n in names:
                for i in range(2, len(n) - 1):
                    if n[i:] in good:
                        stems[n[:i]].add(n[i:])
            short: list[str] = []
            for s in sorted((s for s, e in stems.items() if len(e) >= 2), key=len):
                if not any(s.startswith(x) for x in short):
                    short.append(s)
            tails = set().union(*(stems[s] for s in short)) if short else set()
            every |= names | {s + e for s in short for e in tails}
            found |= set(short)
        cp, start = codes(pa.array(sorted(every), pa.string()))
        known[kind] = np.unique(words(cp, start).hash)
        stems_of[kind] = tuple(sorted(found))
    return Names(known["given"], known["family"], stems_of["given"], stems_of["family"])


def fold_name(n: str) -> str:
    return "".join(chr(x) for x in fold_table()[[ord(c) for c in n]] if x > 32)


def _persons(names: Names, w: Words, cp: np.ndarray) -> list[tuple[int, int]]:
    """(first word, last word) of each name: one or two given names and a family name on one line. One of the two
    kinds may have an ending that no listed name has, if its stem is known."""
    is_given, is_family = _inside(names.given, w.hash), _inside(names.family, w.hash)
    folded = w.folded
    spell = lambda i: folded[w.fold_first[i] : w.fold_end[i]].tobytes().decode("utf-32-le")
    like = lambda i, stems: any(s.startswith(t) and len(s) >= len(t) + 2 for s in [spell(i)] for t in stems)
    near = lambda i: 0 <= i and i + 1 < len(w.hash) and doc[i] == doc[i + 1] and w.first[i + 1] - w.end[i] <= 3 and not (cp[w.end[i] : w.first[i + 1]] == NEWLINE).any()
    doc = np.searchsorted(w.start, np.arange(len(w.hash)), "right") - 1
    out, last = [], -1
    for i in np.flatnonzero(is_given | is_family).tolist():
        if i <= last:
            continue
        if is_given[i]:
            j = i
            while j - i < 2 and near(j) and is_given[j + 1]:
                j += 1
            if near(j) and (is_family[j + 1] or like(j + 1, names.family_stems)):
                if near(i - 1) and i - 1 > last and j == i and like(i - 1, names.given_stems):
                    i -= 1
                out.append((i, j + 1))
                last = j + 1
        elif near(i - 1) and i - 1 > last and like(i - 1, names.given_stems):
            out.append((i - 1, i))
            last = i
    return out


def _inside(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def find(col: pa.Array, names: Names, dates: bool = False) -> list[tuple[int, str, int, int, str]]:
    """(row, kind, start, end, light text) of each item, by row and start; offsets in code points of the original. With
    dates, labelled dates of birth too (kind date)."""
    cp, start = codes(col)
    g = light_table()[cp]
    keep = np.flatnonzero(g)
    g = g[keep]
    begin = np.searchsorted(keep, start)
    is_digit = (g >= 48) & (g <= 57)
    flag = is_digit | (g == ord("@"))
    if len(g) > 2:
        spelled = ((g[:-2] | 32) == ord("a")) & ((g[1:-1] | 32) == ord("t")) & ((g[2:] == ord("]")) | (g[2:] == ord(")")))
        spelled |= (g[:-2] == ord("ا")) & (g[1:-1] == ord("ی")) & (g[2:] == ord("ٹ"))
        flag[:-2] |= spelled
    cuts = np.unique(np.concatenate([begin, np.flatnonzero(g == NEWLINE) + 1]))
    cuts = cuts[cuts < len(g)]
    lines = np.flatnonzero(np.add.reduceat(flag.astype(np.int32), cuts)) if len(cuts) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(g))
    s = g.tobytes().decode("utf-32-le", "replace")
    taken: list[tuple[int, int, str]] = []
    for lo, hi in zip(cuts[lines].tolist(), ends[lines].tolist(), strict=True):
        t = s[lo:hi]
        own: list[tuple[int, int, str]] = []
        for kind, pattern in (("email", EMAIL), ("id_number", ID_NUMBER), ("phone", PHONE), ("address", ADDRESS)):
            for m in pattern.finditer(t):
                a, b = m.span()
                if all(b <= x or a >= y for x, y, _ in own) and valid(kind, m[0]):
                    own.append((a, b, kind))
        if dates:
            own += [(*m.span("date"), "date") for m in BIRTH.finditer(t) if all(m.end("date") <= x or m.start("date") >= y for x, y, _ in own)]
        taken += [(lo + a, lo + b, k) for a, b, k in own]
    w = words(cp, start)
    for i, j in _persons(names, w, cp):
        taken.append((int(np.searchsorted(keep, w.first[i])), int(np.searchsorted(keep, w.end[j] - 1)) + 1, "person"))
    taken.sort()
    out, reached = [], -1
    for a, b, kind in taken:
        if a < reached:
            continue
        reached = b
        row = int(np.searchsorted(begin, a, "right") - 1)
        out.append((row, kind, int(keep[a] - start[row]), int(keep[b - 1] + 1 - start[row]), s[a:b]))
    return out


def _names(parts: DataFrame) -> Names:
    """The name parts are a fixed, small list; they are read to the driver."""
    return name_table([(r["name"], r["kind"]) for r in parts.select("name", "kind").where("name is not null").toLocalIterator()])


def locate(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(uid, kind, start_at, end_at, pseudonym): one row per item of each row of texts (uid, text)."""
    names, key = _names(parts), secret(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            rows = find(b.column("text"), names)
            if rows:
                at, kind, lo, hi, raw = zip(*rows, strict=True)
                # Of a number the digits without their typed form, so that equal ones agree.
                tags = [canonical(k, p) if k in ("phone", "id_number") else p for k, r in zip(kind, raw, strict=True) for p in (pseudonym(k, r, key),)]
                yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(at)), pa.array(kind), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(tags)], names=["uid", "kind", "start_at", "end_at", "pseudonym"])

    t = texts.select("uid", "text").where("uid is not null and text is not null")
    return t.mapInArrow(run, "uid string, kind string, start_at int, end_at int, pseudonym string")


def mask(texts: DataFrame, parts: DataFrame, key: bytes | None = None) -> DataFrame:
    """(uid, text, pii_masked): every text with its items (and labelled dates of birth) replaced, and how many of each
    kind. One pass over each text, whatever the number of items."""
    names, key = _names(parts), key or secret(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            out, counts = b.column("text").to_pylist(), [{} for _ in range(b.num_rows)]
            for row, items in groupby(find(b.column("text"), names, dates=True), lambda x: x[0]):
                text, pieces, at = out[row], [], 0
                for _, kind, lo, hi, raw in items:
                    pieces += [text[at:lo], placeholder(kind, raw, key)]
                    at = hi
                    tag = f"<{kind.upper()}>"
                    counts[row][tag] = counts[row].get(tag, 0) + 1
                out[row] = "".join([*pieces, text[at:]])
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out, pa.string()), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))], names=["uid", "text", "pii_masked"])

    return texts.select("uid", "text").mapInArrow(run, "uid string, text string, pii_masked map<string,bigint>")


def found(build: DataFrame, parts: DataFrame) -> DataFrame:
    """(uid, kind, start_at), distinct."""
    return locate(build, parts).select("uid", "kind", "start_at").distinct()


def report(build: DataFrame, parts: DataFrame) -> DataFrame:
    """Per kind: items, records and distinct persons or addresses behind them."""
    return locate(build, parts).distinct().groupBy("kind").agg(F.count("*").alias("n_items"), F.count_distinct("uid").alias("n_records"), F.count_distinct("pseudonym").alias("n_distinct"))
