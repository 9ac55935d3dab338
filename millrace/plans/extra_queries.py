"""Round trips through sinks, positional chains, copied lines, contact masking, check digits and chunking."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..operators.tokenizing import byte_bpe, default_path, merge_ranks, ranks
from ..session import cut, discard, scratch
from ..sources import readers, sinks
from .catalog import query
from .dedup_queries import met_in_train


@query("select doc_id, md5(text) as digest, source from documents")
def s01_s04_k01_json_round_trip(s, d):
    """The documents' three columns written as JSON lines and read back under a schema."""
    at = scratch(s, "json")
    sinks.json_lines(readers.pruned_parquet(s, f"{d}/documents.parquet", ["doc_id", "text", "source"]), at)
    back = cut(readers.json_lines(s, at, "doc_id bigint, text string, source string").select("doc_id", F.md5("text").alias("digest"), "source"))
    discard(s, at)
    return back


@query("select count(*) as n_lines from (select unnest(string_split(text, chr(10))) as l from documents where text is not null) where regexp_replace(l, '\\s', '', 'g') <> ''")
def s12_k07_line_view(s, d):
    at = scratch(s, "lines")
    sinks.line_view(table(s, d, "documents", "text").where("text is not null"), at, "text")
    n = cut(s.read.text(at).agg(F.count("*").alias("n_lines")))
    discard(s, at)
    return n


_DL = "(select doc_id, unnest(range(len(x))) as pos, unnest(x) as l from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null))"


@query(f"""with l as (select doc_id, pos, md5(l) as k, length(l) as n from {_DL} where length(l) >= 12), ok as (select k from l group by k having count(distinct doc_id) between 2 and 40), m as (select l.* from l join ok using (k)),
p as (select a.doc_id as a, b.doc_id as b, a.pos, a.pos - b.pos as shift, a.n from m a join m b on a.k = b.k and a.doc_id < b.doc_id), r as (select *, pos - row_number() over (partition by a, b, shift order by pos) as run from p)
select a, b, shift, min(pos) as start_pos, count(*) as n_lines, sum(n) < 40 as vetoed from r group by a, b, shift, run having count(*) >= 2""")
def j13_d23_positional_chains(s, d):
    """Runs of lines that two documents have at the same distance; runs of under 40 characters are vetoed."""
    l = table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l")).where(F.length("l") >= 12)
    l = cut(l.select("doc_id", "pos", F.xxhash64("l").alias("k"), F.length("l").alias("n")))
    ok = l.select("k", "doc_id").distinct().groupBy("k").agg(F.count("*").alias("c")).where("c between 2 and 40").select("k")
    m = l.join(ok, "k", "left_semi")
    b = m.select("k", F.col("doc_id").alias("b"), F.col("pos").alias("pos_b"))
    p = m.withColumnRenamed("doc_id", "a").join(b, "k").where("a < b").select("a", "b", "pos", (F.col("pos") - F.col("pos_b")).alias("shift"), "n")
    r = p.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("a", "b", "shift").orderBy("pos")))
    g = r.groupBy("a", "b", "shift", "run").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n_lines"), (F.sum("n") < 40).alias("vetoed"))
    return g.where("n_lines >= 2").drop("run")


@query(f"with l as (select doc_id, pos, l from {_DL} where length(regexp_replace(l, '\\s', '', 'g')) >= 40), f as (select l, min((doc_id, pos)) as first from l group by l) select l.doc_id, l.pos as line_no, f.first[1] as copy_of from l join f using (l) where (l.doc_id, l.pos) <> f.first")
def d18_d19_copied_lines(s, d):
    """Substantive lines that an earlier place has, with the document of the kept first copy."""
    l = table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    l = l.where(F.length(F.regexp_replace("l", r"\s", "")) >= 40)
    first = l.groupBy("l").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    return l.join(first, "l").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no"))).select("doc_id", "line_no", F.col("first.doc_id").alias("copy_of"))


_RAW = "select distinct uid, split, hash(array_to_string(w[i:i + 7], ' ')) as gram from (select uid, split, w, unnest(range(1, len(w) - 6)) as i from (select b.uid, min(m.split) as split, regexp_extract_all(min(b.text), '\\S+') as w from build b join split_manifest m using (uid) where b.text is not null group by b.uid))"


@query(f"with g as ({_RAW}), tr as (select distinct gram from g where split = 'train') select split, count(*) as n_grams, count(tr.gram) as n_met from g left join tr using (gram) where split <> 'train' group by split")
def d11_raw_gram_check(s, d):
    """Overlap with train by unfolded words: an independent check of the folded measure."""
    b = table(s, d, "build", "uid", "text").where("text is not null").groupBy("uid").agg(F.min("text").alias("text"))
    m = table(s, d, "split_manifest", "uid", "split").groupBy("uid").agg(F.min("split").alias("split"))
    g = b.join(m, "uid").select("split", T.gram_hashes(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 8).alias("grams"))
    e = met_in_train(g).where("gram is not null")
    return e.groupBy("split").agg(F.sum("n").alias("n_grams"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_met"))


_ISBN = "97[89]-\\d{1,5}-\\d{1,7}-\\d{1,7}-\\d"


@query(f"with i as (select regexp_replace(x, '-', '', 'g') as n from (select unnest(regexp_extract_all(text, '{_ISBN}')) as x from build where text is not null)) select count(*) as n_isbn, count(*) filter (where length(n) = 13 and list_sum(list_transform(range(1, 14), lambda k: substr(n, k, 1)::int * (case when k % 2 = 1 then 1 else 3 end))) % 10 = 0) as n_valid from i")
def x16_isbn_check_digits(s, d):
    i = table(s, d, "build", "text").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(_ISBN), F.lit(0))).alias("x")).select(F.regexp_replace("x", "-", "").alias("n"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, k: a + F.substr("n", k, F.lit(1)).try_cast("int") * F.when(k % 2 == 1, 1).otherwise(3))
    return i.agg(F.count("*").alias("n_isbn"), F.count_if((F.length("n") == 13) & (total % 10 == 0)).alias("n_valid"))


# How many digits the parts of identity numbers have, and the words that announce one.
ID_PARTS = {(5, 7, 1), (3, 2, 6)}
ID_WORDS = ("شناختی کارڈ", "شناختیکارڈ", "cnic", "nic", "n.i.c")
#: How far behind its word an announced identity number may begin, and how many characters it has at least.
ID_REACH, ID_LEAST = 25, 5


@dataclass(frozen=True)
class Group:
    """A run of digits of a line: where it lies, the digits, and the characters before it."""

    start: int
    end: int
    digits: str
    before: str


def digit_groups(line: str) -> list[Group]:
    """The runs of digits of any script, as ASCII."""
    out: list[Group] = []
    at = 0
    while at < len(line):
        if not line[at].isdecimal():
            at += 1
            continue
        end = at
        while end < len(line) and line[end].isdecimal():
            end += 1
        last = out[-1].end if out else 0
        out.append(Group(at, end, "".join(str(unicodedata.decimal(c)) for c in line[at:end]), line[last:at]))
        at = end
    return out


def _code(g: str, most: int = 5) -> bool:
    """An area code: 0, another digit, one to three more."""
    return 3 <= len(g) <= most and g[0] == "0" and g[1] != "0"


def _mobile(g: str) -> bool:
    """An operator's code, as it is dialled at home (3dd, 03dd) or behind the country code (923dd)."""
    return g[-3:-2] == "3" and g[:-3] in ("", "0", "92") and len(g) >= 3


def contact_kind(groups: list[Group], plus: bool) -> str | None:
    """What a few neighbouring groups of digits are together: an identity number, a phone number or nothing. plus: a plus
    sign stands before the first."""
    sizes, seps = tuple(len(g.digits) for g in groups), [g.before for g in groups[1:]]
    first, last = groups[0].digits, groups[-1].digits
    if len(groups) == 3:
        return "<ID_NUMBER>" if sizes in ID_PARTS and seps == ["-", "-"] else None
    abroad = plus or first.startswith("00")
    if len(groups) == 2:
        if seps[0] not in (" ", "\t", "\xa0", "-", "."):
            return None
        cc = sizes[0] - (0 if plus else 2)
        if abroad and cc in (2, 3) and 6 <= sizes[1] <= 10 or _mobile(first) and sizes[1] == 7 or sizes[0] == 7 and _mobile(last) and not last.startswith("92"):
            return "<PHONE>"
        landline = seps[0] != "." and (_code(first) and 5 <= sizes[1] <= 8 or 5 <= sizes[0] <= 8 and _code(last))
        return "<PHONE>" if landline else None
    if abroad and 8 <= sizes[0] - (0 if plus else 2) <= 13 or sizes[0] >= 10 and _mobile(first[:-7]):
        return "<PHONE>"
    return "<PHONE>" if sizes[0] in (10, 11) and _mobile(first[7:]) and not first[7:].startswith("92") else None


def _announced(low: str, groups: list[Group], i: int) -> tuple[int, int] | None:
    """The span of an identity number at group i that a word announces: digits and dashes, a letter or sign before them."""
    a = groups[i].start
    b = a
    while b < len(low) and (low[b].isdecimal() or low[b] == "-"):
        b += 1
    if b - a < ID_LEAST:
        return None
    window = low[max(0, a - ID_REACH - 14) : a]
    hit = max((window.rfind(w) + len(w) for w in ID_WORDS if w in window), default=-1)
    if hit < 0 or len(window) - hit > ID_REACH or any(c.isdecimal() for c in window[hit:]):
        return None
    if a and low[a - 1] in "+-":
        a -= 1
    if a and low[a - 1].isascii() and low[a - 1].isalpha() and (a < 2 or not low[a - 2].isalpha()):
        a -= 1
    return a, b


def contacts(line: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contact identifiers of a line, from left to right. E-mail addresses come first; of numbers
    the one that takes in most groups of digits wins."""
    out = [(m.start(), m.end(), "<EMAIL>") for m in re.finditer(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", line, re.ASCII)]
    groups, low, i = digit_groups(line), line.lower(), 0
    while i < len(groups):
        span = _announced(low, groups, i)
        kind = "<ID_NUMBER>" if span else None
        for n in (3, 2, 1):
            part = groups[i : i + n]
            if span or len(part) < n:
                continue
            plus = line[part[0].start - 1 : part[0].start] == "+"
            kind = contact_kind(part, plus)
            if kind:
                # A plus sign belongs to the number, two zeros are digits of it.
                span = part[0].start - (plus and kind == "<PHONE>"), part[-1].end
        if span and all(span[1] <= a or span[0] >= b for a, b, _ in out):
            out.append((*span, kind))
        i += 1
        while span and i < len(groups) and groups[i].start < span[1]:
            i += 1
    return sorted(out)


def mask_contacts(text: str) -> tuple[str, dict[str, int]]:
    """The text with contact identifiers replaced, and how many of each."""
    counts, lines = Counter(), []
    for line in text.split("\n"):
        at, pieces = 0, []
        for a, b, kind in contacts(line):
            pieces += [line[at:a], kind]
            at = b
            counts[kind] += 1
        lines.append("".join([*pieces, line[at:]]))
    return "\n".join(lines), dict(counts)


@query()
def x03_mask_contacts(s, d):
    """Only texts with an @ or seven digits reach Python."""

    def run(batches):
        for b in batches:
            got = [mask_contacts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array([c.get(k, 0) for _, c in got for k in ("<EMAIL>",)], pa.int64()), pa.array([c.get("<ID_NUMBER>", 0) for _, c in got], pa.int64()), pa.array([c.get("<PHONE>", 0) for _, c in got], pa.int64()), pa.array([t for t, _ in got], pa.string())], names=["uid", "emails", "ids", "phones", "text"])

    b = table(s, d, "build", "uid", "text").where(F.col("text").rlike(r"@|([0-9٠-٩۰-۹][^\n]{0,4}){7}")).distinct()
    m = b.mapInArrow(run, "uid string, emails bigint, ids bigint, phones bigint, text string")
    return m.select("uid", "emails", "ids", "phones", F.md5("text").alias("digest"))


def chunk_lines(lines: list[str], least: int, heads) -> list[list[str]]:
    """Chunks of at least so many lines that never end on a headword; a short rest joins the last chunk."""
    out: list[list[str]] = [[]]
    for line in lines:
        if len(out[-1]) >= least and not heads(out[-1][-1]):
            out.append([])
        out[-1].append(line)
    if len(out) > 1 and len(out[-1]) < least:
        rest = out.pop()
        out[-1] += rest
    return out


@query()
def w14_lexicon_chunks(s, d):
    """Lines of list-like records in chunks of ten that never end on a line of one word."""

    def run(batches):
        for b in batches:
            rows = []
            for u, t in zip(b.column("uid").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows += [(u, i, len(c)) for i, c in enumerate(chunk_lines([x for x in t.split("\n") if x.strip()], 10, lambda x: len(x.split()) == 1)) if c]
            c = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), pa.string()), pa.array(list(c[1]), pa.int32()), pa.array(list(c[2]), pa.int32())], names=["uid", "chunk", "n_lines"])

    b = table(s, d, "build", "uid", "text").where("uid is not null and text is not null").where(F.size(F.split("text", "\n")) >= 15).groupBy("uid").agg(F.min("text").alias("text"))
    return b.mapInArrow(run, "uid string, chunk int, n_lines int")


@query("select count(*) as n_types, count(*) as n_agree from (select distinct w from (select unnest(regexp_extract_all(text, '[\\p{L}]+')) as w from documents where text is not null))")
def t16_merge_rank_encoder(s, d):
    """Every word type through the merge-rank encoder and through the library: they must agree."""

    def run(batches):
        encode, given = byte_bpe(), ranks(default_path("byte_bpe_50k.tiktoken"))
        for b in batches:
            w = b.column("w").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([merge_ranks(x.encode(), given) == y for x, y in zip(w, encode(w), strict=True)])], names=["same"])

    w = table(s, d, "documents", "text").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).distinct()
    return w.mapInArrow(run, "same boolean").agg(F.count("*").alias("n_types"), F.count_if("same").alias("n_agree"))
