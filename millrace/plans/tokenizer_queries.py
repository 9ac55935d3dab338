"""Token counts, metrics and checks of given tokenizers. Tokenizers are never trained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import table
from ..operators.tokenizing import encoded, lossy
from .catalog import query


def _docs(s, d):
    return table(s, d, "documents", "doc_id", "text", "source", "lang").where("text is not null and text <> ''")


@query("select p as pretoken, count(*) as n from (select unnest(regexp_extract_all(text, ' ?[\\p{L}\\p{M}]+| ?\\p{N}+| ?[^\\s\\p{L}\\p{M}\\p{N}]+')) as p from documents where text is not null) group by p having count(*) >= 3")
def t01_x23_pretoken_counts(s, d):
    t = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r" ?[\p{L}\p{M}]+| ?\p{N}+| ?[^\s\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("pretoken"))
    return t.groupBy("pretoken").agg(F.count("*").alias("n")).where("n >= 3")


@query()
def t08_u01_encode(s, d):
    e = encoded(_docs(s, d), "doc_id", "text", "byte_bpe")
    return e.select("doc_id", F.size("ids").alias("n_tokens"), F.size(F.array_distinct("ids")).alias("n_types"))


@query("select doc_id, strlen(text) as n_tokens from documents where text <> ''")
def t08_byte_adapter(s, d):
    return encoded(_docs(s, d), "doc_id", "text", "utf8_bytes").select("doc_id", F.size("ids").alias("n_tokens"))


@query()
def t14_robustness_matrix(s, d):
    """Relative token counts of two tokenizers under three perturbations, by language: a sum per text, one join."""
    base = _docs(s, d)
    p = base.select("doc_id", "lang", F.explode(F.create_map(
        F.lit("none"), "text",
        F.lit("no_harakat"), F.regexp_replace("text", "[\\x{064B}-\\x{065F}\\x{0670}]", ""),
        F.lit("arabic_keyboard"), F.translate("text", "یکہ", "يكه"),
    )).alias("perturbation", "text"))
    p = p.withColumn("key", F.concat_ws(":", "doc_id", "perturbation", F.coalesce("lang", F.lit("-"))))
    out = None
    for name in ("byte_bpe", "piece_bpe"):
        e = encoded(p, "key", "text", name).select(F.split("key", ":").alias("k"), F.size("ids").alias("n"))
        e = e.groupBy(F.lit(name).alias("tokenizer"), F.col("k")[2].alias("lang"), F.col("k")[1].alias("perturbation")).agg(F.sum("n").alias("n_tokens"))
        out = e if out is None else out.unionByName(e)
    return out


@query("select count(*) as n, 0 as n_lossy from documents where text <> ''")
def t09_t10_x31_round_trip(s, d):
    """Texts whose tokens' bytes don't give the text again (none is expected of a byte-level vocabulary)."""
    return lossy(_docs(s, d), "doc_id", "text").agg(F.count("*").alias("n"), F.count_if(~F.col("lossless")).alias("n_lossy"))


@query("select count(*) as n, " + ", ".join(f"count(*) filter (where contains(text, '{m}')) as {n}" for m, n in (("<|endoftext|>", "endoftext"), ("<unk>", "unk"), ("<PHONE>", "phone"))) + " from build where text is not null")
def t11_special_markers(s, d):
    b = table(s, d, "build", "text").where("text is not null")
    return b.agg(F.count("*").alias("n"), *(F.count_if(F.col("text").contains(m)).alias(n) for m, n in (("<|endoftext|>", "endoftext"), ("<unk>", "unk"), ("<PHONE>", "phone"))))


_FERT = "select lang, round(sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')))::double / sum(strlen(text)), 6) as words_per_byte, round(sum(strlen(text))::double / sum(length(text)), 6) as bytes_per_char from documents where text <> '' group by lang"


@query(_FERT)
def a07_text_ratios(s, d):
    t = _docs(s, d)
    w = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return t.groupBy("lang").agg(F.round(F.sum(w) / F.sum(F.octet_length("text")), 6).alias("words_per_byte"), F.round(F.sum(F.octet_length("text")) / F.sum(F.length("text")), 6).alias("bytes_per_char"))


@query("with h as (select id, min(learned_tokens) as k, min(dev_bytes_per_token) as y from health_gates_and_support where id is not null and learned_tokens is not null and dev_bytes_per_token is not null group by id), n as (select id, (k - min(k) over ())::double / (max(k) over () - min(k) over ()) as x, (y - min(y) over ()) / (max(y) over () - min(y) over ()) as y from h) select id, round(y - x, 6) as gain from n order by y - x desc, id limit 1")
def t13_w16_knee(s, d):
    h = table(s, d, "health_gates_and_support", "id", "learned_tokens", "dev_bytes_per_token").dropna().groupBy("id").agg(F.min("learned_tokens").alias("k"), F.min("dev_bytes_per_token").alias("y"))
    lim = h.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    n = h.crossJoin(F.broadcast(lim)).select("id", ((F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) - (F.col("k") - F.col("k0")) / (F.col("k1") - F.col("k0"))).alias("g"))
    return n.orderBy(F.desc("g"), "id").limit(1).select("id", F.round("g", 6).alias("gain"))
