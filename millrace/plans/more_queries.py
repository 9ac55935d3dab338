"""Further scalar functions, line rules, repeated runs, revisions, counts and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..operators.broadcast import bounded, shuffled
from ..operators.graph import components
from ..operators.normalize import normalized
from ..operators.ranking import ranked
from ..operators.selection import choose
from ..operators.tokenizing import encoded
from ..operators.windows import char_windows
from ..session import cut
from ..sources.readers import html_text, repair_mojibake
from .catalog import query
from .text_queries import LEAK_SQL


def _docs(s, d):
    return table(s, d, "documents", "doc_id", "text", "source", "lang").where("text is not null")


def _records(s, d, *cols):
    """One row per uid with its least text."""
    return table(s, d, "build", "uid", "text", *cols).where("uid is not null and text is not null").groupBy("uid").agg(F.min("text").alias("text"), *(F.min(c).alias(c) for c in cols))


@query("select doc_id, md5(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{200b}\\x{200d}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{feff}]', '', 'g')) as digest from documents where text is not null")
def x01_normalize_unicode(s, d):
    import unicodedata

    import pyarrow as pa

    def run(batches):
        for b in batches:
            t = [unicodedata.normalize("NFC", x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t, pa.string())], names=["doc_id", "text"])

    n = _docs(s, d).select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string")
    return n.select("doc_id", F.md5(T.normalize_invisible(F.col("text"))).alias("digest"))


@query()
def x04_x05_u05_canonical_normalize(s, d):
    n = normalized(_docs(s, d), "doc_id", "text")
    return n.select("doc_id", F.md5("text").alias("digest"), F.coalesce(F.aggregate(F.map_values("report"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("n_changes"))


_L = "(select uid, unnest(range(len(x))) as pos, unnest(x) as l from (select uid, string_split(min(text), chr(10)) as x from build where uid is not null and text is not null group by uid))"


def _lines(s, d):
    return _records(s, d).select("uid", F.posexplode(F.split("text", "\n")).alias("pos", "l"))


def _c(p: str) -> str:
    return f"(length(l) - length(regexp_replace(l, '{p}', '', 'g')))"


_KIND = (
    f"case when {_c('[A-Za-z]')} * 2 > {_c('[\\p{{L}}]')} and {_c('[\\p{{L}}]')} > 0 then 'latin' when regexp_matches(l, '[ټډړږښڅځڼېۍ]') then 'pashto' "
    f"when {_c('[ٹڈڑےں]')} = 0 and {_c('[\\x{{0600}}-\\x{{06FF}}]')} >= 10 and regexp_matches(l, '(^|\\s)(از|را|است|این|که)(\\s|$)') then 'persian' when {_c('[\\x{{0600}}-\\x{{06FF}}]')} > 0 then 'urdu_hindko' else 'other' end"
).replace("{{", "{").replace("}}", "}")


@query(f"select {_KIND} as kind, count(*) as n_lines, count(distinct uid) as n_records from {_L} group by 1")
def x13_x32_line_language_rules(s, d):
    l, c = _lines(s, d), F.col("l")
    n = lambda p: T.count(c, p)
    arabic = n(r"[\x{0600}-\x{06FF}]")
    kind = (
        F.when((n("[A-Za-z]") * 2 > n(r"\p{L}")) & (n(r"\p{L}") > 0), "latin").when(c.rlike("[ټډړږښڅځڼېۍ]"), "pashto")
        .when((n("[ٹڈڑےں]") == 0) & (arabic >= 10) & c.rlike(r"(^|\s)(از|را|است|این|که)(\s|$)"), "persian").when(arabic > 0, "urdu_hindko").otherwise("other")
    )
    per = l.groupBy("uid", kind.alias("kind")).agg(F.count("*").alias("k"))
    return per.groupBy("kind").agg(F.sum("k").alias("n_lines"), F.count("*").alias("n_records"))


@query()
def x21_mojibake_lines(s, d):
    """Lines that read as UTF-8 once more when taken as Latin-1 bytes; only candidates reach Python."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [repair_mojibake(x) != x for x in b.column("l").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("pos"), pa.array(got)], names=["uid", "line_no", "repaired"])

    return _lines(s, d).where(F.col("l").rlike(r"[\x{80}-\x{ff}]{2}")).mapInArrow(run, "uid string, line_no int, repaired boolean").where("repaired").select("uid", "line_no")


@query("select doc_id, len(regexp_extract_all(text, '\\S+')) as n_spans, list_max(list_transform(regexp_extract_all(text, '\\S+'), lambda x: length(x))) as longest from documents where text <> ''")
def x24_word_spans(s, d):
    w = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return _docs(s, d).where("text <> ''").select("doc_id", F.size(w).alias("n_spans"), F.array_max(F.transform(w, lambda x: F.length(x))).alias("longest"))


@query()
def x27_segmentation_changes(s, d):
    """By language, how far tokens change when harakat are dropped: token counts and texts changed."""
    x = _docs(s, d).where("text <> ''").select("doc_id", "lang", "text", F.regexp_replace("text", "[\\x{064B}-\\x{065F}\\x{0670}]", "").alias("bare"))
    a = encoded(x, "doc_id", "text", "byte_bpe").withColumnRenamed("ids", "a")
    b = encoded(x, "doc_id", "bare", "byte_bpe").withColumnRenamed("ids", "b")
    y = x.select("doc_id", "lang").join(a, "doc_id").join(b, "doc_id")
    return y.groupBy("lang").agg(F.count_if(F.col("a") != F.col("b")).alias("n_changed"), F.sum(F.size("a")).alias("tokens_before"), F.sum(F.size("b")).alias("tokens_after"))


_WHY = "case when text = x then 'equal' when lower(text) = lower(x) then 'case' when regexp_replace(text, '\\s+', ' ', 'g') = regexp_replace(x, '\\s+', ' ', 'g') then 'spaces' when translate(text, 'يك', 'یک') = translate(x, 'يك', 'یک') then 'letters' else 'other' end"


@query(f"with t as (select text, lower(regexp_replace(translate(text, 'يك', 'یک'), '\\s+', ' ', 'g')) as x from documents where text is not null) select {_WHY} as reason, count(*) as n from t group by 1")
def x28_round_trip_reasons(s, d):
    t = _docs(s, d).select("text", F.lower(F.regexp_replace(F.translate("text", "يك", "یک"), r"\s+", " ")).alias("x"))
    sp = lambda c: F.regexp_replace(c, r"\s+", " ")
    why = F.when(F.col("text") == F.col("x"), "equal").when(F.lower("text") == F.lower("x"), "case").when(sp("text") == sp("x"), "spaces").when(F.translate("text", "يك", "یک") == F.translate("x", "يك", "یک"), "letters").otherwise("other")
    return t.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


_GENRE = "coalesce(case when register is not null then 'register:' || register end, case when source = 'book' then 'book' end, case when section is not null then 'section:' || section end, 'unknown')"


@query(f"select {_GENRE} as genre, count(*) as n from build group by 1")
def x14_x34_genre_precedence(s, d):
    b = table(s, d, "build", "register", "source", "section")
    g = F.coalesce(F.concat(F.lit("register:"), "register"), F.when(F.col("source") == "book", "book"), F.concat(F.lit("section:"), "section"), F.lit("unknown"))
    return b.groupBy(g.alias("genre")).agg(F.count("*").alias("n"))


_FOLD = f"array_to_string({LEAK_SQL.format('text')}, ' ')"
_KEEP = f"""with t as (select doc_id, lang, text, {LEAK_SQL.format('text')} as w from documents where text is not null), b as (select {LEAK_SQL.format('text')} as w from build where text is not null),
bg as (select distinct array_to_string(w[i:i + 7], ' ') as g from (select w, unnest(range(1, len(w) - 6)) as i from b)), tg as (select distinct doc_id, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from t)),
bc as (select distinct substr(x, i, 24) as g from (select x, unnest(range(1, length(x) - 22)) as i from (select array_to_string(w, ' ') as x from b))), tc as (select distinct doc_id, substr(x, i, 24) as g from (select doc_id, x, unnest(range(1, length(x) - 22)) as i from (select doc_id, array_to_string(w, ' ') as x from t))),
w8 as (select doc_id, avg((bg.g is not null)::int) as v from tg left join bg using (g) group by doc_id), c24 as (select doc_id, avg((bc.g is not null)::int) as v from tc left join bc using (g) group by doc_id)
select lang, count(*) as n_kept from t left join w8 using (doc_id) left join c24 using (doc_id) where len(regexp_extract_all(text, '\\S+')) >= 20 and coalesce(w8.v, 0) < 0.1 and coalesce(c24.v, 0) < 0.2
and (length(text) - length(regexp_replace(text, '[\\x{{0600}}-\\x{{06FF}}]', '', 'g')))::double / greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) >= 0.6 and (length(text) - length(replace(text, chr(65533), '')))::double / length(text) < 0.001 group by lang"""


@query(_KEEP)
def f20_keep_rule(s, d):
    """Documents out of the built corpus: 20 words or more, under a tenth of their word runs and a fifth of their character
    windows met in build, mostly in the script and hardly a replacement character."""
    folded = F.array_join(T.leak_words(F.col("text")), " ")
    t, b = _docs(s, d), table(s, d, "build", "uid", "text").where("text is not null")
    grams = lambda df, key: df.select(key, F.explode(F.array_distinct(T.gram_hashes(T.leak_words(F.col("text")), 8))).alias("h"))

    def share(own, corpus, name):
        met = corpus.select("h").distinct().withColumn("hit", F.lit(1))
        return own.join(shuffled(met), "h", "left").groupBy("doc_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias(name))

    w8 = share(grams(t, "doc_id"), grams(b, "uid"), "w8")
    c24 = share(char_windows(t, "doc_id", folded, 24), char_windows(b, "uid", folded, 24), "c24")
    c = F.col("text")
    keep = (
        (F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))) >= 20) & (F.coalesce("w8", F.lit(0.0)) < 0.1) & (F.coalesce("c24", F.lit(0.0)) < 0.2)
        & (T.count(c, r"[\x{0600}-\x{06FF}]") / F.greatest(F.length(F.regexp_replace(c, r"\s", "")), F.lit(1)) >= 0.6) & (T.count(c, "\ufffd") / F.length(c) < 0.001)
    )
    return t.join(shuffled(w8), "doc_id", "left").join(shuffled(c24), "doc_id", "left").where(keep).groupBy("lang").agg(F.count("*").alias("n_kept"))


CLOSED = ("دا", "دی", "دے", "کا", "کی", "کے", "the", "of", "د", "په")
_TYPES = "(select w, count(*) as n, count(distinct source) as units from (select source, unnest(regexp_extract_all(text, '[\\p{L}]+')) as w from documents where text is not null) group by w)"


def _types(s, d):
    w = _docs(s, d).select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n"), F.count_distinct("source").alias("units"))


@query(f"select w as word, n, units from {_TYPES} where n >= 10 and units >= 3 and length(w) between 3 and 12 and w not in ({', '.join(repr(x) for x in CLOSED)})")
def f21_morphology_candidates(s, d):
    c = s.createDataFrame([(x,) for x in CLOSED], "w string")
    return _types(s, d).where("n >= 10 and units >= 3 and length(w) between 3 and 12").join(F.broadcast(c), "w", "left_anti").select(F.col("w").alias("word"), "n", "units")


@query(f"with v as (select w, n from {_TYPES} where n >= 3), c as (select a.w as stem, x, b.n from v a, (values ('اں'), ('ی'), ('ے'), ('وں')) s(x) join v b on b.w = a.w || x), g as (select stem, count(*) as cells, sum(n) as n from c group by stem) select stem, cells, case when cells >= 2 then 'strong' else 'weak' end as evidence, n from g")
def l12_paradigm_induction(s, d):
    v = _types(s, d).where("n >= 3").select("w", "n")
    c = v.select(F.col("w").alias("stem"), F.explode(F.array(*(F.lit(x) for x in ("اں", "ی", "ے", "وں")))).alias("x")).withColumn("w", F.concat("stem", "x")).join(v, "w")
    g = c.groupBy("stem").agg(F.count("*").alias("cells"), F.sum("n").alias("n"))
    return g.select("stem", "cells", F.when(F.col("cells") >= 2, "strong").otherwise("weak").alias("evidence"), "n")


_SH = "(select distinct item_id, substr(x, i, 5) as g from (select item_id, x, unnest(range(1, greatest(length(x) - 3, 2))) as i from (select item_id, regexp_replace(text, '\\s+', '', 'g') as x from eval_items where text is not null)))"


@query(f"with g as (select * from {_SH}), n as (select item_id, count(*) as n from g group by item_id), p as (select a.item_id as a, b.item_id as b, count(*) as c from g a join g b on a.g = b.g and a.item_id < b.item_id group by 1, 2) select a, b, round(c::double / (x.n + y.n - c), 4) as jaccard from p join n x on x.item_id = a join n y on y.item_id = b where c::double / (x.n + y.n - c) >= 0.05")
def d04_exact_jaccard_pairs(s, d):
    """Exact Jaccard of character shingles over the fixed test items, through the shingles they share."""
    i = table(s, d, "eval_items", "item_id", "text").where("text is not null")
    g = cut(i.select("item_id", F.explode(T.char_shingles(F.col("text"))).alias("g")))
    n = g.groupBy("item_id").agg(F.count("*").alias("n"))
    p = g.withColumnRenamed("item_id", "a").join(g.withColumnRenamed("item_id", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    p = p.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("n1")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("n2")), "b")
    j = F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))
    return p.where(j >= 0.05).select("a", "b", F.round(j, 4).alias("jaccard"))


#: A repeated run counts from so many lines with so many different ones, if the earlier one lies far enough
#: before it, or it is long, or has a long line.
RUN, KINDS, GAP, CHARS, LINE = 5, 2, 100, 1000, 200
_RUNS = f"select uid, shift, min(pos) as start_pos, count(*) as n_lines from r group by uid, shift, run having count(*) >= {RUN} and count(distinct k) >= {KINDS} and (shift >= {GAP} or sum(n) >= {CHARS} or max(n) >= {LINE})"


@query(f"with k as (select uid, pos, length(l) as n, md5(l) as k, min(pos) over (partition by uid, md5(l)) as first_pos from {_L} where l <> ''), r as (select *, pos - first_pos as shift, pos - row_number() over (partition by uid, pos - first_pos order by pos) as run from k where pos > first_pos) {_RUNS}")
def d16_repeated_runs(s, d):
    return repeated_runs(_lines(s, d).where("l <> ''"))


def repeated_runs(lines):
    """Runs of lines that repeat earlier lines of the same record at one distance, under the rule above. lines: (uid, pos, l)."""
    k = lines.select("uid", "pos", F.xxhash64("l").alias("k"), F.length("l").alias("n"))
    k = k.withColumn("first", F.min("pos").over(Window.partitionBy("uid", "k"))).where("pos > first").withColumn("shift", F.col("pos") - F.col("first"))
    r = k.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("uid", "shift").orderBy("pos")))
    g = r.groupBy("uid", "shift", "run").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n_lines"), F.count_distinct("k").alias("kinds"), F.sum("n").alias("chars"), F.max("n").alias("longest"))
    far = (F.col("shift") >= GAP) | (F.col("chars") >= CHARS) | (F.col("longest") >= LINE)
    return g.where((F.col("n_lines") >= RUN) & (F.col("kinds") >= KINDS) & far).select("uid", "shift", "start_pos", "n_lines")


_SITES = """f as (select distinct site as f, l from (select site, unnest(string_split(text, chr(10))) as l from build where site is not null and text is not null) where length(l) >= 12), z as (select f, sum(length(l)) as n from f group by f),
k as (select f.* from f join (select l from f group by l having count(*) between 2 and 40) using (l)), p as (select a.f as a, b.f as b, sum(length(a.l)) as c from k a join k b on a.l = b.l and a.f < b.f group by 1, 2),
e as (select a, b from p join z x on x.f = a join z y on y.f = b where c >= 0.5 * x.n and x.n >= 2000 or c >= 0.5 * y.n and y.n >= 2000)"""


@query(f"with recursive {_SITES}, w as (select a, b from e union select b, a from e), r as (select f as node, f as other from z union select r.node, w.b from r join w on r.other = w.a), c as (select node, min(other) as component from r group by node) select c.node as site, c.component, first_value(z.f) over (partition by c.component order by z.n desc, z.f) as canonical from c join z on z.f = c.node")
def d21_d22_revision_clusters(s, d):
    return revision_clusters(table(s, d, "build", "site", "text").where("site is not null and text is not null"))


def revision_clusters(texts):
    """Sites that share half the characters of the distinct lines of one with 2,000 or more of them form a cluster; the
    largest is canonical and the others are superseded by it. texts: (site, text)."""
    f = cut(texts.select(F.col("site").alias("f"), F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 12).distinct())
    z = f.groupBy("f").agg(F.sum(F.length("l")).alias("n"))
    k = f.join(f.groupBy("l").agg(F.count("*").alias("c")).where("c between 2 and 40").select("l"), "l", "left_semi")
    p = k.withColumnRenamed("f", "a").join(k.withColumnRenamed("f", "b"), "l").where("a < b").groupBy("a", "b").agg(F.sum(F.length("l")).alias("c"))
    e = p.join(z.select(F.col("f").alias("a"), F.col("n").alias("n1")), "a").join(z.select(F.col("f").alias("b"), F.col("n").alias("n2")), "b").where("c >= 0.5 * n1 and n1 >= 2000 or c >= 0.5 * n2 and n2 >= 2000")
    c = components(e.select("a", "b"), z.select(F.col("f").alias("node"))).withColumnRenamed("node", "f").join(z, "f")
    top = c.groupBy("component").agg(F.min_by("f", F.struct(-F.col("n"), "f")).alias("canonical"))
    return c.join(top, "component").select(F.col("f").alias("site"), "component", "canonical")


@query("select substr(w, i, 1) as a, substr(w, i + 1, 1) as b, sum(n) as n from (select w, n, unnest(range(1, length(w))) as i from (select w, count(*) as n from (select unnest(regexp_extract_all(text, '[\\p{L}]+')) as w from documents where text is not null) group by w)) group by 1, 2 having sum(n) >= 50")
def a28_pair_counts(s, d):
    """Adjacent letter pairs, counted over word types and weighted by their frequency."""
    w = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.length("w") > 1)
    p = w.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.struct(F.substr("w", i, F.lit(1)).alias("a"), F.substr("w", i + 1, F.lit(1)).alias("b")))).alias("p"))
    return p.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where("n >= 50")


_HU = f"(select l, len(list_filter(w, lambda t: t in ({', '.join(repr(x) for x in T.HINDKO_TOKENS)}))) as h, len(list_filter(w, lambda t: t in ({', '.join(repr(x) for x in T.URDU_TOKENS)}))) as u, w from (select l, regexp_extract_all(l, '[\\p{{L}}]+') as w from {_L}))"


@query(f"with c as (select case when h >= 0.8 * (h + u) then 'hindko' when h <= 0.2 * (h + u) then 'urdu' end as lang, unnest(w) as w from {_HU} where h + u >= 3) select w as word, count(*) filter (where lang = 'hindko') as n_hindko, count(*) filter (where lang = 'urdu') as n_urdu from c where lang is not null group by w having count(*) >= 10")
def a31_language_conditioned_counts(s, d):
    l = _lines(s, d).select(F.regexp_extract_all("l", F.lit(r"[\p{L}]+"), F.lit(0)).alias("w"))
    l = l.select("w", F.size(F.filter("w", lambda t: t.isin(*T.HINDKO_TOKENS))).alias("h"), F.size(F.filter("w", lambda t: t.isin(*T.URDU_TOKENS))).alias("u")).where("h + u >= 3")
    lang = F.when(F.col("h") >= 0.8 * (F.col("h") + F.col("u")), "hindko").when(F.col("h") <= 0.2 * (F.col("h") + F.col("u")), "urdu")
    c = l.select(lang.alias("lang"), F.explode("w").alias("word")).where("lang is not null")
    return c.groupBy("word").agg(F.count_if(F.col("lang") == "hindko").alias("n_hindko"), F.count_if(F.col("lang") == "urdu").alias("n_urdu")).where("n_hindko + n_urdu >= 10")


@query("with g as (select l.doc_id, max((l.category <> 'none')::int) as gold from content_labels l where category is not null group by l.doc_id), p as (select doc_id, (max(coalesce(abusive, 0)) > 0)::int as pred from content_labels group by doc_id) select count(*) as n, sum(gold * pred) as tp, round(sum(gold * pred)::double / sum(pred), 4) as precision, round(sum(gold * pred)::double / sum(gold), 4) as recall from g join p using (doc_id)")
def a22_micro_scores(s, d):
    l = table(s, d, "content_labels", "doc_id", "category", "abusive")
    g = l.where("category is not null").groupBy("doc_id").agg(F.max((F.col("category") != "none").cast("int")).alias("gold"))
    p = l.groupBy("doc_id").agg((F.max(F.coalesce("abusive", F.lit(0))) > 0).cast("int").alias("pred"))
    tp = F.sum(F.col("gold") * F.col("pred"))
    return g.join(p, "doc_id").agg(F.count("*").alias("n"), tp.alias("tp"), F.round(tp / F.sum("pred"), 4).alias("precision"), F.round(tp / F.sum("gold"), 4).alias("recall"))


@query()
def l09_group_selection(s, d):
    """Groups for a twentieth of all words per source: sizes chosen from their histogram, members by hash."""
    m = table(s, d, "split_manifest", "uid", "group_key", "source", "n_words").distinct().where("n_words is not null and group_key is not null")
    g = m.groupBy("source", "group_key").agg(F.sum("n_words").alias("n"))
    g = cut(g.withColumn("source", F.coalesce("source", F.lit(""))))
    by: dict[str, dict[int, int]] = {}
    for r in g.groupBy("source", "n").agg(F.count("*").alias("k")).toLocalIterator():
        by.setdefault(r["source"], {})[int(r["n"])] = r["k"]
    rows = [(src, size, k) for src, h in sorted(by.items()) for size, k in sorted(choose(h, sum(n * c for n, c in h.items()) // 20).items())]
    takes = s.createDataFrame(rows, "source string, n bigint, k bigint")
    return ranked(g, ["source", "n"], "group_key").join(F.broadcast(takes), ["source", "n"]).where("rank < k").select("source", "group_key", F.col("n").alias("n_words"))


@query("with t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null) select doc_id, md5(array_to_string(list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> ''), chr(10))) as digest from t")
def s07_s08_html_text(s, d):
    """Pages made of the documents, escaped, and read back: the main container's text without navigation and scripts."""
    t = _docs(s, d)
    body = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav><main><p>"), body, F.lit("</p><script>x</script></main><footer>end</footer></body></html>"))
    return html_text(t.select("doc_id", page.alias("html")), "doc_id", "html").select("doc_id", F.md5("text").alias("digest"))


@query(f"with i as (select item_id, {LEAK_SQL.format('text')} as w from eval_items where text is not null), t as (select doc_id, {LEAK_SQL.format('text')} as w from documents where text is not null), ig as (select distinct item_id, substr(x, i, 24) as g from (select item_id, x, unnest(range(1, greatest(length(x) - 22, 1))) as i from (select item_id, array_to_string(w, ' ') as x from i))), dg as (select distinct substr(x, i, 24) as g from (select x, unnest(range(1, greatest(length(x) - 22, 1))) as i from (select array_to_string(w, ' ') as x from t))) select item_id, count(*) as n_grams, round(avg((dg.g is not null)::int), 4) as overlap from ig left join dg using (g) group by item_id")
def d09_eval_overlap_chars(s, d):
    """Share of each test item's 24-character windows met in the corpus."""
    folded = F.array_join(T.leak_words(F.col("text")), " ")
    i = cut(char_windows(table(s, d, "eval_items", "item_id", "text"), "item_id", folded, 24))
    wanted = bounded(cut(i.select("h").distinct()))
    hit = char_windows(_docs(s, d), "doc_id", folded, 24).join(wanted, "h", "left_semi").select("h").distinct().withColumn("hit", F.lit(1))
    return i.join(hit, "h", "left").groupBy("item_id").agg(F.count("*").alias("n_grams"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("overlap"))


@query("select md5(text) as key, min(doc_id) as doc_id, count(*) as n from documents where text is not null group by 1")
def g03_g05_content_memo(s, d):
    """One row per content hash: what a memo table keeps, so that a rerun skips texts it has."""
    return _docs(s, d).groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
