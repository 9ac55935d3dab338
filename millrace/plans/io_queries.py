"""Sources and sinks as round trips: what is written and read back must be what the tables hold."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..io import table
from ..operators.tokenizing import encoded
from ..session import cut, discard, scratch
from ..sources import readers, sinks
from .catalog import query
from .text_queries import _GATED, _TIER, gated


def _docs(s, d, *cols):
    return table(s, d, "documents", "doc_id", "text", *cols).where("text is not null")


@query("select doc_id, md5(text) as digest from documents where text is not null")
def s02_malformed_lines(s, d):
    """JSON lines among broken ones (every record is followed by its own line cut short): the broken ones are skipped."""
    at = scratch(s, "lines")
    line = F.to_json(F.struct("doc_id", "text"))
    _docs(s, d).select(F.concat(line, F.lit("\n"), F.substring(line, 1, 12)).alias("value")).write.text(at)
    back = cut(readers.json_lines(s, at, "doc_id bigint, text string", "drop").select("doc_id", F.md5("text").alias("digest")))
    discard(s, at)
    return back


@query("select container_id, capacity_tokens from containers")
def s03_json_listing(s, d):
    """A listing: one JSON document with an array of records, of the fixed table of containers."""
    at = scratch(s, "listing")
    rows = table(s, d, "containers", "container_id", "capacity_tokens")
    rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct("container_id", "capacity_tokens")))).alias("value")).write.text(at)
    back = cut(readers.json_listing(s, at, "container_id int, capacity_tokens bigint"))
    discard(s, at)
    return back


def docx_bytes(text: str) -> bytes:
    """A minimal DOCX file with a paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("select item_id, md5(text) as digest, 'docx' as kind from eval_items where text is not null")
def s06_f15_docx(s, d):
    """Test items as DOCX files: their kind by the first bytes, and their text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([docx_bytes(t) for t in b.column("text").to_pylist()], pa.binary())], names=["item_id", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("kind"), pa.array([readers.docx_text(x) for x in b.column("content").to_pylist()], pa.string())], names=["item_id", "kind", "text"])

    files = table(s, d, "eval_items", "item_id", "text").where("text is not null").mapInArrow(write, "item_id bigint, content binary")
    kinds = files.withColumn("kind", readers.file_kind(F.col("content")))
    return kinds.mapInArrow(read, "item_id bigint, kind string, text string").select("item_id", F.md5("text").alias("digest"), "kind")


@query("select doc_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title from documents where text is not null and title is not null")
def s09_page_metadata(s, d):
    """Pages' titles beside their main text."""
    e = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    t = _docs(s, d, "title").where("title is not null")
    page = F.concat(F.lit("<html><head><title>"), e(F.col("title")), F.lit("</title></head><body><article>"), e(F.col("text")), F.lit("</article></body></html>"))
    back = readers.html_text(t.select("doc_id", page.alias("html")), "doc_id", "html")
    return back.select("doc_id", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


@query("select doc_id, category, count(*) as n from content_labels where doc_id is not null and category is not null group by 1, 2")
def s11_validated_table(s, d):
    """Labels written as a tab-separated table and read with a check of every row."""
    at = scratch(s, "labels")
    table(s, d, "content_labels", "doc_id", "category").where("doc_id is not null and category is not null").write.option("sep", "\t").option("header", "true").csv(at)
    valid = F.col("doc_id").isNotNull() & F.col("category").isin("none", "abusive", "hateful", "sexual")
    back = cut(readers.delimited(s, at, "doc_id bigint, category string", valid).groupBy("doc_id", "category").agg(F.count("*").alias("n")))
    discard(s, at)
    return back


@query("select 2 * count(*) as n_rules, sum(len(string_split(text, chr(10)))) + count(*) + 2 * count(*) as n_lines from documents where text is not null")
def k02_readable_text(s, d):
    """Texts with a header between two rules."""
    at = scratch(s, "readable")
    rule = "=" * 40
    sinks.readable(_docs(s, d).withColumn("title", F.col("doc_id").cast("string")), at, "title", "text", rule)
    back = cut(s.read.option("lineSep", "\n").text(at).agg(F.count_if(F.col("value") == rule).alias("n_rules"), F.count("*").alias("n_lines")))
    discard(s, at)
    return back


@query(f"{_GATED} select doc_id, array_to_string(r, ';') as reasons, md5(text) as digest from g where {_TIER} = 'reject'")
def k03_rejected(s, d):
    """Rejected bodies and the index of their reasons, written apart and joined again."""
    at = scratch(s, "rejected")
    sinks.rejected(gated(s, d).select("doc_id", "text", "tier", F.array_join("r", ";").alias("reasons")), at)
    index, bodies = s.read.parquet(f"{at}/index"), s.read.parquet(f"{at}/bodies")
    back = cut(index.select("doc_id", "reasons").join(bodies.select("doc_id", F.md5("text").alias("digest")), "doc_id"))
    discard(s, at)
    return back


@query("select doc_id, copy_of from (select doc_id, min(doc_id) over (partition by md5(text)) as copy_of from documents where text is not null) where doc_id <> copy_of")
def k04_k08_duplicates_table(s, d):
    """The audit of exact copies as a CSV table."""
    at = scratch(s, "audit")
    x = _docs(s, d).select("doc_id", F.md5("text").alias("h"))
    audit = x.join(x.groupBy("h").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")).where("n > 1").drop("n"), "h").where("doc_id <> copy_of").select("doc_id", "copy_of")
    sinks.table(audit, at)
    back = cut(s.read.option("header", "true").schema("doc_id bigint, copy_of bigint").csv(at))
    discard(s, at)
    return back


@query("select 'by_source' as part, source as key, count(*) as n from documents group by 2 union all select 'by_lang', lang, count(*) from documents group by 2")
def k05_k06_report_promoted(s, d):
    """Nested counts written to a staging folder as JSON, promoted when complete, and read from where they belong."""
    docs = table(s, d, "documents", "source", "lang")
    parts = {f"by_{c}": docs.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")) for c in ("source", "lang")}
    staged, target = scratch(s, "staged"), scratch(s, "released")
    sinks.report(parts, staged)
    sinks.promote(s, staged, target, list(parts))
    out = None
    for name in parts:
        one = s.read.schema("key string, n bigint").json(f"{target}/{name}").select(F.lit(name).alias("part"), "key", "n")
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    discard(s, target)
    return out


@query("select count(*) as n_texts, sum(strlen(text))::bigint as n_tokens from documents where text is not null")
def u02_custom_encoder(s, d):
    """An encoder of one's own, named as module:factory, used like any other: here one token per byte."""
    e = encoded(_docs(s, d), "doc_id", "text", "millrace.plans.io_queries:bytes_encoder")
    return e.agg(F.count("*").alias("n_texts"), F.sum(F.size("ids")).alias("n_tokens"))


def bytes_encoder(path=None):
    return lambda texts: [list(t.encode()) for t in texts]


#: Perturbations of a text by name, as columns.
PERTURBATIONS = {
    "none": lambda c: c,
    "no_harakat": lambda c: F.regexp_replace(c, "[\\x{064B}-\\x{065F}\\x{0670}]", ""),
    "arabic_keyboard": lambda c: F.translate(c, "یکہ", "يكه"),
    "single_spaces": lambda c: F.regexp_replace(c, r"\s+", " "),
    "upper_case": F.upper,
}


@query("with t as (select text, unnest(['none', 'no_harakat', 'arabic_keyboard', 'single_spaces', 'upper_case']) as name from documents where text is not null), p as (select name, text, case name when 'none' then text when 'no_harakat' then regexp_replace(text, '[\\x{064B}-\\x{065F}\\x{0670}]', '', 'g') when 'arabic_keyboard' then translate(text, 'یکہ', 'يكه') when 'single_spaces' then regexp_replace(text, '\\s+', ' ', 'g') else upper(text) end as q from t) select name, count(*) filter (where q <> text) as n_changed, sum(length(q)) as n_chars from p group by name")
def u03_perturbations(s, d):
    """Every registered perturbation over all texts: how many it changes, and the characters left."""
    t = _docs(s, d).select("text", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), f(F.col("text")).alias("q")) for n, f in PERTURBATIONS.items()))).alias("p"))
    return t.groupBy("p.name").agg(F.count_if(F.col("p.q") != F.col("text")).alias("n_changed"), F.sum(F.length("p.q")).alias("n_chars"))


@query("with p as (select text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as gold, string_split(text, ' ') as got from documents where text is not null) select count(*) as n, count(*) filter (where gold = got) as n_exact, round(sum(len(list_intersect(list_distinct(gold), list_distinct(got))))::double / sum(len(list_distinct(got))), 4) as precision, round(sum(len(list_intersect(list_distinct(gold), list_distinct(got))))::double / sum(len(list_distinct(gold))), 4) as recall from p")
def u04_evaluate(s, d):
    """An encoder against gold pieces: here splitting at single spaces against splitting at any."""
    gold = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return evaluate(_docs(s, d), F.split("text", " "), gold)


def evaluate(df, got, gold):
    """Exact matches, and precision and recall of distinct pieces, summed over all rows."""
    p = df.select(got.alias("got"), gold.alias("gold"))
    both = F.sum(F.size(F.array_intersect("got", "gold")))
    return p.agg(
        F.count("*").alias("n"), F.count_if(F.col("got") == F.col("gold")).alias("n_exact"),
        F.round(both / F.sum(F.size(F.array_distinct("got"))), 4).alias("precision"), F.round(both / F.sum(F.size(F.array_distinct("gold"))), 4).alias("recall"),
    )
