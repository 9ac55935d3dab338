"""Record-level predicates, scalar text functions and gates, over documents and build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from .catalog import query

A = T.ARABIC
SOLID = "regexp_replace({0}, '\\s', '', 'g')"


def _sf(c: str) -> str:
    s = SOLID.format(c)
    return f"case when length({s}) > 0 then (length({s}) - length(regexp_replace({s}, '[{A}]', '', 'g')))::double / length({s}) else 0.0 end"


def _nl(c: str) -> str:
    s = SOLID.format(c)
    return f"case when length({s}) > 0 then length(regexp_replace({s}, '[{T.LANGUAGE}]', '', 'g'))::double / length({s}) else 1.0 end"


def _lines(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _rep(c: str) -> str:
    ls = _lines(c)
    return f"case when len({ls}) >= 2 then list_max(list_transform({ls}, lambda x: len(list_filter({ls}, lambda y: y = x))))::double / len({ls}) else 0.0 end"


def _wc(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text", "source", "lang").where("text is not null")


def r4(c):
    return F.round(c, 4)


@query(f"select doc_id, round({_sf('text')}, 4) as script_fraction from documents where text is not null")
def f01_script_fraction(s, d):
    return _docs(s, d).select("doc_id", r4(T.script_fraction(F.col("text"))).alias("script_fraction"))


@query(f"select doc_id, round({_nl('text')}, 4) as non_language_ratio from documents where text is not null")
def f02_non_language_ratio(s, d):
    return _docs(s, d).select("doc_id", r4(T.non_language_ratio(F.col("text"))).alias("non_language_ratio"))


@query(f"select doc_id, round({_rep('text')}, 4) as max_line_repeat from documents where text is not null")
def f03_max_line_repeat(s, d):
    return _docs(s, d).select("doc_id", r4(T.max_line_repeat(F.col("text"))).alias("max_line_repeat"))


@query(f"select doc_id, {_wc('text')} as n_words from documents where text is not null")
def f04_word_count(s, d):
    return _docs(s, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def _content(l: str) -> str:
    solid = SOLID.format(l)
    return (
        f"(length({l}) - length(regexp_replace({l}, '[{A}]', '', 'g'))) >= 4 and length(regexp_replace({l}, '^\\s+|\\s+$', '', 'g')) >= 12 "
        f"and not (length({solid}) > 200 and {_sf(l)} < 0.30)"
    )


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) as l from documents where text is not null) select doc_id, count(*) as n_lines, count(*) filter (where {_content('l')}) as n_content from l group by doc_id")
def f05_content_lines(s, d):
    l = _docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return l.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_content_line(F.col("l"))).alias("n_content"))


@query(f"select doc_id, length(title) between 20 and 160 and not regexp_matches(title, '[A-Za-z_|@~`{{}}\\[\\]<>=+*#$%^&\\\\]') and {_sf('title')} >= 0.8 as valid from documents where title is not null")
def f06_valid_titles(s, d):
    return table(s, d, "documents", "doc_id", "title").where("title is not null").select("doc_id", T.is_valid_title(F.col("title")).alias("valid"))


PLACES, DESKS = T.PLACES, T.DESKS


@query(
    f"with l as (select uid, unnest(string_split(text, chr(10))) as l from build where text is not null) select count(*) as n_lines, "
    f"count(*) filter (where regexp_matches(l, '^({'|'.join(PLACES)})\\s*[(،,]') or regexp_matches(l, '^[^\\s()،,]{{2,24}}\\([^)]*({'|'.join(DESKS)})[^)]*\\)')) as n_datelines, "
    f"count(*) filter (where length(l) <= 80 and regexp_matches(l, '^\\s*(ہفت\\s*روزہ|ہفتہ\\s*وار|روزنامہ)')) as n_mastheads from l"
)
def f07_datelines_f08_mastheads(s, d):
    l = table(s, d, "build", "uid", "text").where("text is not null").select(F.explode(F.split("text", "\n")).alias("l"))
    c = F.col("l")
    masthead = (F.length(c) <= 80) & c.rlike(r"^\s*(ہفت\s*روزہ|ہفتہ\s*وار|روزنامہ)")
    return l.agg(F.count("*").alias("n_lines"), F.count_if(T.is_dateline(c, PLACES, DESKS)).alias("n_datelines"), F.count_if(masthead).alias("n_mastheads"))


_AD = f"({' + '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})::int' for w in T.AD_WORDS)})"
_OPENS = "regexp_extract(regexp_replace(text, '^\\s+', ''), '^[^\\n]*')"
_DATELINE = f"(regexp_matches({_OPENS}, '^({'|'.join(PLACES)})\\s*[(،,]') or regexp_matches({_OPENS}, '^[^\\s()،,]{{2,24}}\\([^)]*({'|'.join(DESKS)})[^)]*\\)'))"
_AD_SQL = f"(((regexp_matches(text, '{T.PHONE}') and {_AD} >= 1) or {_AD} >= 3 or (regexp_matches(text, '(?i){T.URL}') and {_AD} >= 2)) and not {_DATELINE})"


@query(f"select uid, bool_or({_AD_SQL}) as ad from build where text is not null group by uid")
def f09_looks_like_ad(s, d):
    return table(s, d, "build", "uid", "text").where("text is not null").groupBy("uid").agg(F.bool_or(T.looks_like_ad(F.col("text"))).alias("ad"))


def _two(hard: str, a: str, soft: str, b: str) -> str:
    return f"case when {hard} then '{a}' when {soft} then '{b}' end"


_S, _P = T.STRICT, T.PERMISSIVE
_METRICS = f"select doc_id, source, text, length(text) as n, {_wc('text')} as w, {_sf('text')} as sf, {_nl('text')} as nl, {_rep('text')} as rep, coalesce((length(text) - length(replace(text, chr(65533), '')))::double / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0), 0) as bad, {_AD_SQL} as ad from documents where text is not null"
_REASONS = (
    "list_filter([case when n = 0 then 'empty' end, "
    + _two(f"n < {_P['min_chars']}", "too_short", f"n < {_S['min_chars']}", "below_strict_length") + ", "
    + _two(f"w < {_P['min_words']}", "too_few_words", f"w < {_S['min_words']}", "below_strict_words") + ", "
    + _two(f"sf < {_P['min_script']}", "low_script_fraction", f"sf < {_S['min_script']}", "below_strict_script_fraction") + ", "
    + _two(f"nl > {_P['max_other']}", "excess_non_language", f"nl > {_S['max_other']}", "below_strict_non_language") + ", "
    + _two(f"rep > {_P['max_repeat']}", "excessive_repetition", f"rep > {_S['max_repeat']}", "below_strict_repetition") + ", "
    + _two(f"bad > {_P['max_corrupt']}", "corrupt_glyphs", f"bad > {_S['max_corrupt']}", "below_strict_glyph_purity")
    + ", case when ad then 'advertisement' end], lambda x: x is not null)"
)
_TIER = f"case when len(r) = 0 then 'strict' when list_has_any(r, [{', '.join(repr(h) for h in T.HARD)}]) then 'reject' else 'permissive' end"
_GATED = f"with m as ({_METRICS}), g as (select *, {_REASONS} as r from m)"


def gated(s: SparkSession, d: str) -> DataFrame:
    x = _docs(s, d).withColumn("g", T.gate(F.col("text"), T.looks_like_ad(F.col("text"))))
    return x.withColumn("r", F.col("g.r")).withColumn("tier", F.col("g.tier")).drop("g")


@query(f"{_GATED} select doc_id, array_to_string(r, ';') as reasons, {_TIER} as tier from g")
def f10_gate_reasons_f11_tier(s, d):
    return gated(s, d).select("doc_id", F.array_join("r", ";").alias("reasons"), "tier")


@query(f"{_GATED}, e as (select unnest(r) as code from g) select code, count(*) as n from e group by code")
def a02_reason_counts(s, d):
    return gated(s, d).select(F.explode("r").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


_DEMOTE = """
with b as (select uid, min(source) as source, min(role) as role, min(coalesce(language_variety, '')) as variety, bool_or(list_has_any(coalesce(content_flags, []), ['listing_page'])) as listing, min(length(text)) as n from build group by uid)
select source, count(*) filter (where source = 'book' and n < 60 and n > 0) as short_units, count(*) filter (where source = 'web' and lower(trim(variety)) not in ('hindko', 'urdu')) as other_language,
  count(*) filter (where source = 'web' and listing) as listings, count(*) as n_records from b group by source
"""


@query(_DEMOTE)
def f12_source_aware_demotions(s, d):
    b = table(s, d, "build", "uid", "source", "role", "language_variety", "content_flags", "text")
    listing = F.array_contains(F.coalesce("content_flags", F.array().cast("array<string>")), "listing_page")
    b = b.groupBy("uid").agg(F.min("source").alias("source"), F.min(F.coalesce("language_variety", F.lit(""))).alias("variety"), F.bool_or(listing).alias("listing"), F.min(F.length("text")).alias("n"))
    web = F.col("source") == "web"
    return b.groupBy("source").agg(
        F.count_if((F.col("source") == "book") & (F.col("n") < 60) & (F.col("n") > 0)).alias("short_units"),
        F.count_if(web & ~F.lower(F.trim("variety")).isin("hindko", "urdu")).alias("other_language"),
        F.count_if(web & F.col("listing")).alias("listings"),
        F.count("*").alias("n_records"),
    )


_CLEAN = "regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{200b}\\x{200d}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{feff}]', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '\\r\\n?', chr(10), 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '[_|~`{{}}<>\\\\]', '', 'g'), '\\x{{0640}}+', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '[ \\t\\x{{00a0}}\\x{{2007}}\\x{{202f}}]+', ' ', 'g')"
for _p in "،۔؛:!؟?.-—–":
    _CLEAN = f"regexp_replace({_CLEAN}, '[{_p}]{{3,}}', '{_p * 2}', 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+([،۔؛:!؟?.)\\]…])', '\\1', 'g'), '\\(\\s+', '(', 'g')"
_CLEAN = f"array_to_string(list_filter({_lines(_CLEAN)}, lambda l: not regexp_matches(l, '^[0-9۰-۹]{{1,4}}$')), chr(10))"


@query(f"select doc_id, md5({_CLEAN}) as cleaned, length({_CLEAN}) as n_chars from documents where text is not null")
def x02_clean_text(s, d):
    c = T.clean_text(F.col("text"))
    return _docs(s, d).select("doc_id", F.md5(c).alias("cleaned"), F.length(c).alias("n_chars"))


@query(f"select count(*) as n_empty from documents where text is not null and {_CLEAN} = ''")
def f13_empty_after_clean(s, d):
    return _docs(s, d).where(T.clean_text(F.col("text")) == "").agg(F.count("*").alias("n_empty"))


@query(f"""{_GATED}, u as (select * from (select *, {_TIER} as tier, row_number() over (partition by md5({_CLEAN}) order by doc_id) as rn from g) where rn = 1)
select tier, source, count(*) as n_docs, sum(n) as n_chars, sum(w) as n_words from u group by tier, source""")
def tiered_corpus_report(s, d):
    """The flagship: cleaned, gated, exactly deduplicated documents counted by tier and source."""
    x = gated(s, d).withColumn("digest", F.md5(T.clean_text(F.col("text"))))
    x = x.select("digest", "doc_id", "tier", "source", F.length("text").alias("n"), T.word_count(F.col("text")).alias("w"))
    first = x.groupBy("digest").agg(F.min_by(F.struct("tier", "source", "n", "w"), "doc_id").alias("r")).select("r.*")
    return first.groupBy("tier", "source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.sum("w").alias("n_words"))


_TOK = "list_filter(regexp_split_to_array(regexp_replace(text, '[\\x{064B}-\\x{065F}\\x{0670}]', '', 'g'), '[\\s،؛؟۔.,:;!?()\\[\\]\"''‘’“”/\\-_*…0-9۰-۹٠-٩\\x{FFFD}]+'), lambda t: t <> '')"


def _hits(ms: tuple[str, ...]) -> str:
    return f"len(list_filter({_TOK}, lambda t: t in ({', '.join(repr(m) for m in ms)})))"


@query(f"""with m as (select doc_id, {_hits(T.HINDKO_TOKENS)} as h, {_hits(T.URDU_TOKENS)} as u from documents where text is not null)
select doc_id, h, u, round(case when h + u = 0 then 0.5 else h::double / (h + u) end, 4) as score,
 case when h + u = 0 then 'no_signal' when h::double / (h + u) >= 0.7 then 'hindko' when h::double / (h + u) <= 0.3 then 'urdu' else 'mixed' end as variety from m""")
def x10_marker_variety(s, d):
    c = F.col("text")
    m = _docs(s, d).select("doc_id", T.marker_hits(c, T.HINDKO_TOKENS).alias("h"), T.marker_hits(c, T.URDU_TOKENS).alias("u"))
    return m.select("doc_id", "h", "u", r4(T.marker_score(F.col("h"), F.col("u"))).alias("score"), T.variety(F.col("h"), F.col("u")).alias("variety"))


_SUB = ("دا ", "دی ", "دے ", "نال", "اچ ", "سی ", "اوہ", "پئے", "ہوسی")


@query(f"select doc_id, {' + '.join(f'((length(text) - length(replace(text, {chr(39)}{m}{chr(39)}, {chr(39)}{chr(39)}))) // {len(m)})' for m in _SUB)} as hits from documents where text is not null")
def x11_substring_markers(s, d):
    c = F.col("text")
    hits = sum((F.floor((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m)) for m in _SUB), F.lit(0))
    return _docs(s, d).select("doc_id", hits.cast("bigint").alias("hits"))


@query(f"select doc_id, len({_TOK}) as n_tokens from documents where text is not null")
def x09_tokens(s, d):
    return _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def _n(cls: str) -> str:
    return f"(length(l) - length(regexp_replace(l, '{cls}', '', 'g')))"


@query(f"""with l as (select uid, unnest(string_split(text, chr(10))) as l from (select distinct uid, text from build where text is not null))
select uid, sum({_n('[A-Za-z]')}) as latin, sum({_n('[\\x{064B}-\\x{065F}\\x{0670}]')}) as harakat, sum({_n('[پچژگ]')}) as perso_urdu, sum({_n('[ٹڈڑںےۓ]')}) as urdu_only, count(*) as n_lines from l group by uid""")
def x12_line_features(s, d):
    l = table(s, d, "build", "uid", "text").where("text is not null").distinct().select("uid", F.explode(F.split("text", "\n")).alias("l"))
    n = lambda p: F.sum(T.count(F.col("l"), p))
    return l.groupBy("uid").agg(n("[A-Za-z]").alias("latin"), n("[\\x{064B}-\\x{065F}\\x{0670}]").alias("harakat"), n("[پچژگ]").alias("perso_urdu"), n("[ٹڈڑںےۓ]").alias("urdu_only"), F.count("*").alias("n_lines"))


_FOLD = f"lower(translate(regexp_replace({{0}}, '[\\p{{{{Mn}}}}\\p{{{{Me}}}}\\p{{{{Cf}}}}\\x{{{{0640}}}}]', '', 'g'), '{T.LEAK_FROM}', '{T.LEAK_TO}'))"
LEAK_SQL = "regexp_extract_all(" + _FOLD + ", '[\\p{{L}}\\p{{N}}]+')"


@query(f"select doc_id, len({LEAK_SQL.format('text')}) as n_words, md5(array_to_string({LEAK_SQL.format('text')}, ' ')) as folded from documents where text is not null")
def x06_leak_words(s, d):
    w = T.leak_words(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, " ")).alias("folded"))


@query("select doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), '^ | $', '', 'g')) as key from documents where text is not null")
def x07_overlap_key(s, d):
    return _docs(s, d).select("doc_id", F.md5(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^\\p{L}]+", " "), "^ | $", "")).alias("key"))


@query("with l as (select unnest(string_split(text, chr(10))) as l from documents where text is not null) select regexp_replace(regexp_replace(l, '\\s+', ' ', 'g'), '^ | $', '', 'g') as key, count(*) as n from l group by 1 having count(*) >= 3")
def x08_line_keys(s, d):
    l = _docs(s, d).select(F.explode(F.split("text", "\n")).alias("l"))
    return l.groupBy(T.line_key(F.col("l")).alias("key")).agg(F.count("*").alias("n")).where("n >= 3")


_PATH = "regexp_replace(source_path, '[\\\\/]+', '/', 'g')"


@query(f"""with p as (select distinct source_path, {_PATH} as p from build where source_path is not null),
q as (select *, regexp_extract(p, '(?i)issue\\s*no\\.?\\s*(\\d{{2,4}})', 1) as a, lower(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '')) as stem from p)
select source_path, case when a <> '' then a end as issue,
 case when contains(stem, 'idari') or contains(stem, 'idary') then 'editorial' when contains(stem, 'front page') or starts_with(stem, 'fp') then 'front_page' when contains(stem, 'back page') then 'back_page' when regexp_matches(stem, '^p\\s*\\d') then 'inner_page' end as section from q""")
def x17_path_metadata(s, d):
    p = table(s, d, "build", "source_path").where("source_path is not null").distinct()
    clean = F.regexp_replace("source_path", r"[\\/]+", "/")
    issue = F.regexp_extract(clean, r"(?i)issue\s*no\.?\s*(\d{2,4})", 1)
    stem = F.lower(F.regexp_replace(F.regexp_extract(clean, "([^/]*)$", 1), r"\.[^.]*$", ""))
    section = F.when(stem.contains("idari") | stem.contains("idary"), "editorial").when(stem.contains("front page") | stem.startswith("fp"), "front_page").when(stem.contains("back page"), "back_page").when(stem.rlike(r"^p\s*\d"), "inner_page")
    return p.select("source_path", F.when(issue != "", issue).alias("issue"), section.alias("section"))


@query("with g as (select uid, text from (select distinct uid, text from build where text is not null)) select uid, len(list_distinct(list_transform(range(1, greatest(length(regexp_replace(text, '\\s+', '', 'g')) - 3, 1)), lambda i: substr(regexp_replace(text, '\\s+', '', 'g'), i, 5)))) as n_shingles from g where length(regexp_replace(text, '\\s+', '', 'g')) >= 5")
def d02_x18_char_shingles(s, d):
    b = table(s, d, "build", "uid", "text").where("text is not null").distinct()
    return b.where(F.length(F.regexp_replace("text", r"\s+", "")) >= 5).select("uid", F.size(T.char_shingles(F.col("text"))).alias("n_shingles"))


@query("select doc_id, sha1(text) as h1, sha256(text) as h2, md5(text) as h3 from documents where text is not null")
def x19_hashes(s, d):
    return _docs(s, d).select("doc_id", F.sha1("text").alias("h1"), F.sha2("text", 256).alias("h2"), F.md5("text").alias("h3"))


@query("select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://(www\\.)?', ''), '^([^/:]+):(80|443)(/|$)', '\\1\\3'), '/+$', '')) as canonical from documents where url is not null")
def x20_canonical_url(s, d):
    return table(s, d, "documents", "doc_id", "url").where("url is not null").select("doc_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("select doc_id, length(trim(regexp_replace(regexp_replace('<p>' || text || '</p><br>', '<[^>]{1,40}>', ' ', 'g'), '\\s+', ' ', 'g'))) as n_chars from documents where text is not null")
def x22_tag_strip(s, d):
    x = F.concat(F.lit("<p>"), "text", F.lit("</p><br>"))
    return _docs(s, d).select("doc_id", F.length(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]{1,40}>", " "), r"\s+", " "))).alias("n_chars"))


@query("""select doc_id, length(regexp_replace(text, '[\\x{064B}-\\x{065F}\\x{0670}]', '', 'g')) as no_harakat, md5(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) as digits,
 length(regexp_replace(text, '\\s*([،۔؟!])\\s*', ' \\1 ', 'g')) as punct_space, length(replace(text, chr(8204), '')) as no_zwnj, md5(translate(text, 'یکہ', 'يكه')) as arabic_keyboard from documents where text is not null""")
def x25_x26_perturbations(s, d):
    c = F.col("text")
    return _docs(s, d).select(
        "doc_id",
        F.length(F.regexp_replace(c, "[\\x{064B}-\\x{065F}\\x{0670}]", "")).alias("no_harakat"),
        F.md5(F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")).alias("digits"),
        F.length(F.regexp_replace(c, r"\s*([،۔؟!])\s*", " $1 ")).alias("punct_space"),
        F.length(F.replace(c, F.lit("‌"), F.lit(""))).alias("no_zwnj"),
        F.md5(F.translate(c, "یکہ", "يكه")).alias("arabic_keyboard"),
    )


@query(f"""with w as (select unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) as w from documents where text is not null)
select case when regexp_matches(w, '^[A-Za-z]+$') then 'latin' when regexp_matches(w, '^[{A}]+$') then 'arabic' when regexp_matches(w, '^\\p{{N}}+$') then 'number' else 'mixed' end as class, count(*) as n, count(distinct w) as n_types from w group by 1""")
def x29_piece_class(s, d):
    w = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("w"))
    c = F.when(F.col("w").rlike("^[A-Za-z]+$"), "latin").when(F.col("w").rlike(f"^[{A}]+$"), "arabic").when(F.col("w").rlike(r"^\p{N}+$"), "number").otherwise("mixed")
    return w.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("n_types"))


@query("select doc_id, strlen(text) as n_bytes, length(text) as n_chars from documents where text is not null")
def x30_byte_lengths(s, d):
    return _docs(s, d).select("doc_id", F.octet_length("text").alias("n_bytes"), F.length("text").alias("n_chars"))


@query(f"""with l as (select uid, unnest({_lines('text')}) as l from (select distinct uid, text from build where text is not null and source = 'book')),
f as (select uid, avg((length(l) <= 60)::int) as share, sum(length(l)) as n from l group by uid) select uid, case when n < 300 then 'insufficient_text' when share >= 0.9 then 'verse' when share <= 0.6 then 'prose' else 'mixed' end as form from f""")
def x33_form(s, d):
    l = table(s, d, "build", "uid", "text", "source").where("text is not null and source = 'book'").select("uid", "text").distinct().select("uid", F.explode(T.lines(F.col("text"))).alias("l"))
    f = l.groupBy("uid").agg(F.avg((F.length("l") <= 60).cast("int")).alias("share"), F.sum(F.length("l")).alias("n"))
    return f.select("uid", F.when(F.col("n") < 300, "insufficient_text").when(F.col("share") >= 0.9, "verse").when(F.col("share") <= 0.6, "prose").otherwise("mixed").alias("form"))


@query("select distinct url from build where url is not null and regexp_matches(url, '/(category|tag|page|author|archive)(/|$)|/20\\d\\d/?$|/20\\d\\d/\\d\\d/?$')")
def f16_listing_urls(s, d):
    return table(s, d, "build", "url").where(F.col("url").rlike(r"/(category|tag|page|author|archive)(/|$)|/20\d\d/?$|/20\d\d/\d\d/?$")).distinct()


_OCR = """with tr as (select uid, regexp_extract_all(text, '[\\p{L}\\p{M}]+') as w, lower(coalesce(extraction_method, '')) like '%ocr%' as scan from (select distinct uid, text, extraction_method from build where text is not null)),
v as (select w, count(*) as c from (select unnest(w) as w from tr where not scan) group by w),
t as (select uid, unnest(w) as w from tr where scan),
j as (select uid, count(*) as tokens, 1 - avg((v.c is not null)::int) as oov_vocab, 1 - avg((coalesce(v.c, 0) >= 5)::int) as oov_common, avg(length(t.w)) as mean_length from t left join v using (w) group by uid)
select uid, tokens, round(oov_vocab, 4) as oov_vocab, round(oov_common, 4) as oov_common, round(mean_length, 3) as mean_length, case when oov_common >= 0.4 then 'unusable' when oov_common >= 0.25 then 'poor' else 'fair' end as verdict from j"""


@query(_OCR)
def f14_ocr_lexical_quality(s, d):
    b = table(s, d, "build", "uid", "text", "extraction_method").where("text is not null").distinct()
    t = b.select("uid", F.regexp_extract_all("text", F.lit("[\\p{L}\\p{M}]+"), F.lit(0)).alias("w"), F.lower(F.coalesce("extraction_method", F.lit(""))).contains("ocr").alias("scan"))
    v = t.where("not scan").select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    j = t.where("scan").select("uid", F.explode("w").alias("w")).join(v, "w", "left").groupBy("uid").agg(
        F.count("*").alias("tokens"), (1 - F.avg(F.col("c").isNotNull().cast("int"))).alias("a"), (1 - F.avg((F.coalesce("c", F.lit(0)) >= 5).cast("int"))).alias("b"), F.avg(F.length("w")).alias("m")
    )
    return j.select("uid", "tokens", r4("a").alias("oov_vocab"), r4("b").alias("oov_common"), F.round("m", 3).alias("mean_length"), F.when(F.col("b") >= 0.4, "unusable").when(F.col("b") >= 0.25, "poor").otherwise("fair").alias("verdict"))
