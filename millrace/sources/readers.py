"""Scans: JSON lines, listings, Parquet, delimited tables with validation, text by mode, HTML, DOCX and binary files."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, malformed: str = "fail") -> DataFrame:
    """One record per line. malformed: fail, drop, or keep (then the line stands in _corrupt_record)."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[malformed]
    if malformed == "keep":
        schema += ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", mode).json(path)


def json_listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that lists records."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def pruned_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def delimited(spark: SparkSession, path: str, schema: str, valid: Column, sep: str = "\t") -> DataFrame:
    """A table with a header row; a row that isn't valid ends the job."""
    df = spark.read.option("sep", sep).option("header", "true").schema(schema).csv(path)
    return df.where(F.assert_true(valid, F.lit("invalid row")).isNull())


def text_units(spark: SparkSession, path: str, mode: str, header: str | None = None) -> DataFrame:
    """(path, unit, text): whole files, lines, or sections that begin with a line matching header."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if mode == "whole":
        return files.select("path", F.lit(0).alias("unit"), "text")
    if mode == "lines":
        units = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    else:
        units = F.filter(F.split("text", f"(?m)(?={header})"), lambda x: F.trim(x) != "")
    return files.select("path", F.posexplode(units).alias("unit", "text"))


# Elements that hold no text of the page, and those that end a block.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template"}
BLOCKS = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article", "main", "tr", "ul", "ol", "table", "body", "figcaption", "dd", "dt"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(html.parser.HTMLParser):
    """Collects the text of blocks, with the main container's apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.all: list[str] = []
        self.main: list[str] = []
        self.title = ""
        self.now = ""

    def _flush(self) -> None:
        lines = [re.sub(r"[ \t\r\f]+", " ", x).strip(" ") for x in self.now.split("\n")]
        lines = [x for x in lines if x]
        self.now = ""
        if lines and not any(t in SKIPPED for t, _ in self.stack):
            self.all += lines
            if any(m for _, m in self.stack):
                self.main += lines

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.now += "\n"
            return
        if tag in BLOCKS or tag in SKIPPED:
            self._flush()
        if tag not in VOID:
            a = dict(attrs)
            hint = f"{a.get('id') or ''} {a.get('class') or ''}".lower()
            self.stack.append((tag, tag in ("main", "article") or a.get("role") == "main" or bool(re.search(r"\b(main-content|entry-content|post-body|article-body)\b", hint))))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if any(t == "title" for t, _ in self.stack):
            self.title += data
        elif not any(t in ("script", "style") for t, _ in self.stack):
            self.now += data

    def close(self) -> None:
        super().close()
        self._flush()


def page_text(source: str | None) -> tuple[str, str]:
    """(title, text) of a page: its main container's blocks if it has one with text, else all of them."""
    if not source:
        return "", ""
    p = _Page()
    p.feed(source)
    p.close()
    return p.title.strip(), "\n".join(p.main or p.all)


def html_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, title, text) of HTML sources; null gives empty strings."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [page_text(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], names=[key, "title", "text"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, title string, text string")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a DOCX file, a line each; null if it isn't one."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for p in root.iter(f"{_WORD}p"):
        parts = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda e: "\t", f"{_WORD}br": lambda e: "\n"}
        out.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
    return "\n".join(out)


#: How files of a kind begin.
MAGIC = {"docx": b"PK\x03\x04", "pdf": b"%PDF-", "ole": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff", "gzip": b"\x1f\x8b"}


def file_kind(content: Column) -> Column:
    """The kind of a binary file by its first bytes; empty, text or unknown else."""
    out = F.when(content.isNull() | (F.length(content) == 0), "empty")
    for name, magic in MAGIC.items():
        out = out.when(F.substring(content, 1, len(magic)) == F.lit(magic), name)
    return out.when(F.is_valid_utf8(content.cast("string")), "text").otherwise("unknown")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, content); files without a byte aren't listed by the scan."""
    return spark.read.format("binaryFile").load(path).select("path", "length", file_kind(F.col("content")).alias("kind"), "content")


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): text is null for what isn't a DOCX file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([docx_text(x) for x in b.column("content").to_pylist()], pa.string())], names=["path", "text"])

    return binary_files(spark, path).select("path", "content").mapInArrow(run, "path string, text string")


def repair_mojibake(text: str) -> str:
    """UTF-8 that was read as Latin-1, read again; any other text as it is."""
    try:
        again = text.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text
    return again


def frontier(seen: DataFrame, links: DataFrame) -> DataFrame:
    """(url): linked pages that weren't seen."""
    return links.select("url").where("url is not null").distinct().join(seen.select("url"), "url", "left_anti")
