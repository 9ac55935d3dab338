"""Lines repeated across one source's documents: PrefixSpan over line identifiers, and removal of what it finds.

Every record becomes the sequence of its lines' identifiers (a hash of a line's folded letters; 0 for lines without a
letter). Per source, PrefixSpan grows closed frequent sequences, single lines included; support is the number of distinct
records. Every frequent line is in a closed sequence, and the occurrences of their lines are deleted.

Null text is a text without lines; null uid, source_path or a source out of scope gives no row; repeated rows of one
uid count once (the smallest sequence is taken should their texts differ); an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded, source_of
from .text import chunks, codes, line_keys, lists, mix

SCOPE = ("newspaper", "web")
MIN_RECORDS, MIN_SHARE = 4, 0.10


def in_scope(build: DataFrame) -> DataFrame:
    """build with src, null where the lines of a record are out of scope."""
    return build.withColumn("src", F.when(F.col("source").isin(*SCOPE), source_of(F.col("source_path"))))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        keys, start = line_keys(*codes(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("src"), lists(keys.view(np.int64), start, pa.int64())], names=["uid", "src", "keys"])


def line_sequences(build: DataFrame) -> DataFrame:
    """(uid, src, keys): the line identifiers of each record in scope, one row per uid, cut from its lineage."""
    rows = in_scope(build).select("uid", "src", "text").where("uid is not null and src is not null")
    rows = rows.mapInArrow(_keys, "uid string, src string, keys array<bigint>")
    return cut(rows.groupBy("uid").agg(F.min(F.struct("src", "keys")).alias("r")).select("uid", "r.src", "r.keys"))


def frequent_lines(records: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(src, key, n_records, n_source): lines in at least so many records and such a share of their source's."""
    lines = records.select("src", F.explode(F.array_distinct("keys")).alias("key")).where("key <> 0")
    often = lines.groupBy("src", "key").agg(F.count("*").alias("n_records")).where(F.col("n_records") >= min_records)
    total = records.groupBy("src").agg(F.count("*").alias("n_source"))
    return cut(often.join(total, "src").where(F.col("n_records") >= min_share * F.col("n_source")))


def _common_start(rest: str) -> str:
    """How many items all rests of a pattern begin with: those that the least and the greatest rest share."""
    return f"if(size(lo_{rest}) = 0, 0, aggregate(sequence(1, greatest(1, least(size(lo_{rest}), size(hi_{rest})))), 0, (a, i) -> if(a = i - 1 and get(lo_{rest}, i - 1) <=> get(hi_{rest}, i - 1), i, a)))"


def prefix_span(records: DataFrame, frequent: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(src, pattern, n_records): the closed frequent sequences of lines, of every length: those that no longer one with
    as many records contains. The lines of a sequence follow one another among a record's frequent lines; what lies
    between them and is not frequent doesn't count.

    Records are reduced to their frequent lines and equal sequences merged with a weight. Each round grows every pattern
    by one item, from the projected places where it ends, and then by all items that follow in every place, so a block of
    lines takes one round whatever its length. A place ends one pattern of each round at the most, hence the rounds'
    states never hold more than the corpus has frequent lines. Patterns of one source are few (each has a share
    min_share of its records) and go back to the places as one map.
    """
    keep = bounded(frequent.select("src", "key"))
    kept = records.select("uid", "src", F.posexplode("keys").alias("pos", "key")).join(keep, ["src", "key"])
    seqs = kept.groupBy("uid", "src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("items"))
    seqs = seqs.groupBy("src", "items").agg(F.count("*").alias("weight"))
    total = cut(frequent.groupBy("src").agg(F.max("n_source").alias("n_source")))
    state = cut(seqs.withColumn("ends", F.expr("transform(sequence(0, size(items) - 1), i -> named_struct('pid', 0L, 'at', i))")))
    spark = records.sparkSession
    last = spark.createDataFrame([], "src string, parent bigint, base array<bigint>")
    found = None
    while True:
        step = "transform(filter(ends, o -> o.at < size(items)), o -> named_struct('pid', xxhash64(o.pid, items[o.at]), 'parent', o.pid, 'item', items[o.at], 'at', o.at + 1))"
        state = state.withColumn("ends", F.expr(step))
        rows = state.select("src", "items", F.expr("transform(ends, (o, i) -> named_struct('o', o, 'w', if(array_position(transform(ends, e -> e.pid), o.pid) = i + 1, weight, 0L)))").alias("e")).select("src", "items", F.explode("e").alias("e"))
        rows = rows.select("src", "e.o.pid", "e.o.parent", "e.o.item", "e.w", F.expr("slice(items, e.o.at + 1, size(items))").alias("rest"))
        level = rows.groupBy("src", "pid").agg(F.min("parent").alias("parent"), F.min("item").alias("item"), F.sum("w").alias("n_records"), F.min("rest").alias("lo_rest"), F.max("rest").alias("hi_rest"))
        level = level.join(total, "src").where((F.col("n_records") >= min_records) & (F.col("n_records") >= min_share * F.col("n_source")))
        level = level.withColumn("k", F.expr(_common_start("rest"))).withColumn("more", F.expr("slice(lo_rest, 1, k)"))
        level = level.join(last, ["src", "parent"], "left").withColumn("pattern", F.concat(F.coalesce("base", F.array().cast("array<bigint>")), F.array("item"), "more"))
        level = cut(level.select("src", "pid", "parent", "k", "pattern", "n_records", F.expr("aggregate(more, pid, (a, x) -> xxhash64(a, x))").alias("to")))
        if level.isEmpty():
            break
        part = level.select("src", F.col("to").alias("pid"), "parent", "pattern", "n_records")
        found = part if found is None else found.unionByName(part)
        last = level.select("src", F.col("to").alias("parent"), F.col("pattern").alias("base"))
        maps = cut(level.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("pid", F.struct("to", "k")))).alias("m")))
        moved = "filter(transform(filter(ends, o -> map_contains_key(m, o.pid)), o -> named_struct('pid', m[o.pid].to, 'at', o.at + m[o.pid].k)), o -> o.at < size(items))"
        state = cut(state.join(bounded(maps), "src").select("src", "items", "weight", F.expr(moved).alias("ends")).where("size(ends) > 0"))
    if found is None:
        return spark.createDataFrame([], "src string, pattern array<bigint>, n_records bigint")
    # A pattern isn't closed if it has as many records with an item more behind it or before it.
    tail = F.expr("aggregate(slice(pattern, 2, size(pattern)), 0L, (a, x) -> xxhash64(a, x))")
    longer = found.select("src", F.col("parent").alias("pid"), "n_records").unionByName(found.select("src", tail.alias("pid"), "n_records"))
    return cut(found.join(longer.distinct(), ["src", "pid", "n_records"], "left_anti").select("src", "pattern", "n_records"))


def sequence_lines(records: DataFrame, frequent: DataFrame) -> DataFrame:
    """(src, key): the lines of the frequent sequences."""
    return cut(prefix_span(records, frequent).select("src", F.explode("pattern").alias("key")).distinct())


def occurrences(records: DataFrame, frequent: DataFrame) -> DataFrame:
    """(uid, line_no) of every line that belongs to a frequent sequence."""
    lines = records.select("uid", "src", F.posexplode("keys").alias("line_no", "key")).where("key <> 0")
    return lines.join(bounded(frequent.select("src", "key")), ["src", "key"], "left_semi").select("uid", "line_no")


def attach(build: DataFrame, frequent: DataFrame) -> DataFrame:
    """(uid, text, furniture) of every row: with the identifiers of its source's frequent lines, null if there are none.
    Other columns of build, whatever their names, are left behind."""
    per = frequent.groupBy("src").agg(F.collect_set("key").alias("furniture"))
    return in_scope(build).select("uid", "text", "src").join(bounded(cut(per)), "src", "left").select("uid", "text", "furniture")


def furniture_lines(keys: np.ndarray, line_start: np.ndarray, furniture: pa.ListArray) -> np.ndarray:
    """Which lines of a batch are furniture, given each record's list of identifiers."""
    if isinstance(furniture, pa.ChunkedArray):
        furniture = furniture.combine_chunks()
    n = np.asarray(pc.fill_null(pc.list_value_length(furniture), 0), np.int64)
    own = np.asarray(furniture.flatten(), np.int64).view(np.uint64)
    doc = mix(np.arange(1, len(n) + 1, dtype=np.uint64))
    mine, theirs = keys ^ np.repeat(doc, np.diff(line_start)), own ^ np.repeat(doc, n)
    return np.isin(mine, theirs) & (keys != 0)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        keys, start = line_keys(*codes(b.column("text")))
        bad = furniture_lines(keys, start, b.column("furniture"))
        texts, gone = [], []
        for t, lo, hi in zip(b.column("text").to_pylist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
            n = int(bad[lo:hi].sum())
            gone.append(n)
            texts.append(t if not n else "\n".join(x for x, k in zip(t.split("\n"), bad[lo:hi].tolist(), strict=True) if not k))
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], names=["uid", "text", "lines_removed"])


def remove(build: DataFrame, frequent: DataFrame) -> DataFrame:
    """(uid, text, lines_removed): every record's text without its source's furniture. One row per row of build."""
    return attach(build, frequent).mapInArrow(_without, "uid string, text string, lines_removed int")
