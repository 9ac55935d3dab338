"""Order-dependent folds that no window expresses: packing with skips, units of at least so many words, segmentation.

Each runs as a fold over one group's ordered rows; the group (a document, a file) is the unit of work, never the
corpus, so tasks stay as small as the largest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def budget_with_skip(sizes: Column, budget: int) -> Column:
    """Of an array of sizes, which are taken when each that still fits the rest of the budget is (array of booleans)."""
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = x <= acc["left"]
        return F.struct((acc["left"] - F.when(fits, x).otherwise(0)).cast("bigint").alias("left"), F.array_append(acc["taken"], fits).alias("taken"))

    return F.aggregate(sizes, start, step, lambda a: a["taken"])


def pack_units(sizes: Column, least: int) -> Column:
    """Sizes of consecutive units: a unit closes when it holds at least so much; a smaller rest joins the last one."""
    start = F.struct(F.lit(0).cast("bigint").alias("open"), F.array().cast("array<bigint>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        now = (acc["open"] + x).cast("bigint")
        full = now >= least
        return F.struct(F.when(full, 0).otherwise(now).cast("bigint").alias("open"), F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"))

    def end(a: Column) -> Column:
        n = F.size(a["done"])
        merged = F.concat(F.slice(a["done"], 1, n - 1), F.array((F.element_at(a["done"], -1) + a["open"]).cast("bigint")))
        return F.when(a["open"] == 0, a["done"]).when(n == 0, F.array(a["open"])).otherwise(merged)

    return F.aggregate(sizes, start, step, end)


def articles(lines: list[str], is_title, is_body) -> list[tuple[str | None, list[str]]]:
    """A title opens an article once the open one has a body; other lines join it."""
    out: list[tuple[str | None, list[str]]] = []
    title: str | None = None
    body: list[str] = []
    for line in lines:
        if is_title(line) and (body or title is None):
            if body:
                out.append((title, body))
            title, body = line, []
        elif is_body(line):
            body.append(line)
    if body:
        out.append((title, body))
    return out


def segment(df: DataFrame, key: str, text: str, title_most: int = 60) -> DataFrame:
    """(key, article, title, n_lines, n_chars): a text's articles, by a state machine over its lines. A line without a
    sentence's end and of at most so many characters is a title."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
                got = articles(lines, lambda x: len(x) <= title_most and x[-1] not in ".!?۔؟،", lambda x: True)
                rows += [(k, i, title, len(body), sum(map(len, body))) for i, (title, body) in enumerate(got)]
            c = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c[0]), b.schema.field(key).type), pa.array(list(c[1]), pa.int32()), pa.array(list(c[2]), pa.string()), pa.array(list(c[3]), pa.int32()), pa.array(list(c[4]), pa.int64())], names=[key, "article", "title", "n_lines", "n_chars"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, article int, title string, n_lines int, n_chars bigint")
