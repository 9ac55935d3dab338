"""Reports and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import table
from .catalog import query




def _one(s, d, *cols):
    return table(s, d, "build", *cols).distinct()


@query("select source, quality_tier, count(*) as n, sum(n_chars) as n_chars, sum(n_words) as n_words from build group by rollup (source, quality_tier)")
def a01_source_tier_rollup(s, d):
    return table(s, d, "build", "source", "quality_tier", "n_chars", "n_words").rollup("source", "quality_tier").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"))


@query("select source, count(*) filter (where v = 'hindko') as hindko, count(*) filter (where v = 'urdu') as urdu, count(*) filter (where v = 'pashto') as pashto from (select source, lower(trim(language_variety)) as v from build) group by source")
def a03_variety_pivot(s, d):
    b = table(s, d, "build", "source", "language_variety").select("source", F.lower(F.trim("language_variety")).alias("v"))
    return b.groupBy("source").pivot("v", ["hindko", "urdu", "pashto"]).agg(F.count(F.lit(1))).na.fill(0)


@query("with r as (select source, n_words, row_number() over (partition by source order by n_words) as rn, count(*) over (partition by source) as n from build where n_words is not null) select source, max(n_words) filter (where rn = n // 2 + 1) as p50, max(n_words) filter (where rn = n * 9 // 10 + 1) as p90 from r group by source")
def a04_rank_quantiles(s, d):
    """Quantiles by rank: counts per distinct value give the ranks, so no group is sorted in one task."""
    c = table(s, d, "build", "source", "n_words").where("n_words is not null").groupBy("source", "n_words").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("n_words")
    r = c.withColumn("hi", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    at = lambda rank: F.min(F.when(F.col("hi") >= rank, F.col("n_words")))
    return r.groupBy("source").agg(at(F.floor(F.col("n") / 2) + 1).alias("p50"), at(F.floor(F.col("n") * 9 / 10) + 1).alias("p90"))


@query("select source, case when n_chars < 200 then '<200' when n_chars < 500 then '<500' when n_chars < 1000 then '<1000' else '1000+' end as bin, count(*) as n, round(quantile_cont(n_chars, 0.5), 4) as median from build where n_chars is not null group by 1, 2")
def a05_histogram(s, d):
    n = F.col("n_chars")
    b = table(s, d, "build", "source", "n_chars").where("n_chars is not null")
    return b.groupBy("source", F.when(n < 200, "<200").when(n < 500, "<500").when(n < 1000, "<1000").otherwise("1000+").alias("bin")).agg(F.count("*").alias("n"), F.round(F.percentile("n_chars", 0.5), 4).alias("median"))


@query("select source, " + ", ".join(f"round(avg(({c} is not null)::int), 4) as {c}" for c in ("title", "date", "author", "issue", "url")) + " from build group by source")
def a06_metadata_coverage(s, d):
    cols = ("title", "date", "author", "issue", "url")
    return table(s, d, "build", "source", *cols).groupBy("source").agg(*(F.round(F.avg(F.col(c).isNotNull().cast("int")), 4).alias(c) for c in cols))


@query("select candidate, round(sum(bits) / sum(bytes), 6) as bits_per_byte, count(*) as n from (select distinct * from bits_records where bits is not null) group by candidate")
def a07_ratio_of_sums(s, d):
    return table(s, d, "bits_records").where("bits is not null").distinct().groupBy("candidate").agg(F.round(F.sum("bits") / F.sum("bytes"), 6).alias("bits_per_byte"), F.count("*").alias("n"))


@query("select source, split, count(*) as n, sum(n_words) as n_words from (select distinct * from split_manifest) group by grouping sets ((), (source), (split))")
def a08_grouping_sets(s, d):
    m = table(s, d, "split_manifest").distinct()
    return m.groupingSets([[], ["source"], ["split"]], "source", "split").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))


@query("with m as (select distinct uid, split, source, n_words from split_manifest), g as (select source, split, sum(n_words) as w from m where n_words is not null group by source, split) select source, split, w as n_words, round(w::double / (select sum(w) from g), 6) as share from g")
def a09_share_table(s, d):
    g = table(s, d, "split_manifest", "uid", "split", "source", "n_words").distinct().where("n_words is not null").groupBy("source", "split").agg(F.sum("n_words").alias("n_words"))
    total = g.agg(F.sum("n_words").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("source", "split", "n_words", F.round(F.col("n_words") / F.col("t"), 6).alias("share"))


_W = "(select unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) as w, source, doc_id from documents where text is not null)"


def _w(s, d):
    t = table(s, d, "documents", "text", "source", "doc_id").where("text is not null")
    return t.select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("w"))


@query(f"select count(distinct w) as vocab_used, count(*) as n_tokens, max(n) as most from (select w, count(*) as n from {_W} group by w) join {_W} using (w)")
def a10_token_histogram(s, d):
    h = _w(s, d).groupBy("w").agg(F.count("*").alias("n"))
    return h.agg(F.count("*").alias("vocab_used"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))


@query(f"with h as (select w, count(*) as n from {_W} group by w), p as (select n::double / (select sum(n) from h) as p from h) select round(log2(sum(pow(p, 2.5))) / (1 - 2.5) / log2(count(*)), 6) as renyi from p")
def a11_renyi_efficiency(s, d):
    h = _w(s, d).groupBy("w").agg(F.count("*").alias("n"))
    t = h.agg(F.sum("n").alias("t"))
    p = h.crossJoin(F.broadcast(t)).select((F.col("n") / F.col("t")).alias("p"))
    return p.agg(F.round(F.log2(F.sum(F.pow("p", F.lit(2.5)))) / (1 - 2.5) / F.log2(F.count("*")), 6).alias("renyi"))


@query(f"select w as word, count(*) as freq, count(*) filter (where source like 'web%') as web, count(distinct doc_id) as n_docs, count(distinct source) as n_units from {_W} group by w having count(*) >= 5")
def a12_word_frequency(s, d):
    return _w(s, d).groupBy(F.col("w").alias("word")).agg(F.count("*").alias("freq"), F.count_if(F.col("source").startswith("web")).alias("web"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_units")).where("freq >= 5")


@query("select ch, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(string_split(text, '')) as ch from documents where text is not null and text <> '') group by ch")
def a13_char_census(s, d):
    c = table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    per = c.groupBy("doc_id", "ch").agg(F.count("*").alias("k"))
    return per.groupBy("ch").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


@query(f"select least(n, 10) as freq, count(*) as n_types from (select w, count(*) as n from {_W} group by w) group by 1")
def a14_frequency_of_frequency(s, d):
    return _w(s, d).groupBy("w").agg(F.count("*").alias("n")).groupBy(F.least("n", F.lit(10)).alias("freq")).agg(F.count("*").alias("n_types"))


@query("select length(r) as len, count(*) as n from (select unnest(regexp_extract_all(text, '[0-9۰-۹٠-٩]+')) as r from documents where text is not null) group by 1")
def a15_digit_runs(s, d):
    t = table(s, d, "documents", "text").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9۰-۹٠-٩]+"), F.lit(0))).alias("r"))
    return t.groupBy(F.length("r").alias("len")).agg(F.count("*").alias("n"))


@query(f"with c as (select w, source, count(*) as n from {_W} group by w, source) select w as piece, sum(n) as n, arg_min(source, (-n, source)) as top_unit, round(max(n)::double / sum(n), 4) as top_share from c group by w having sum(n) >= 20")
def a16_piece_statistics(s, d):
    c = _w(s, d).groupBy("w", "source").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("w").alias("piece")).agg(F.sum("n").alias("total"), F.min_by("source", F.struct(-F.col("n"), "source")).alias("top_unit"), F.round(F.max("n") / F.sum("n"), 4).alias("top_share")).where("total >= 20").withColumnRenamed("total", "n")


@query("select role, count(*) as n, sum((train_d1_freq_lt20 > 10000)::int) as n_weak, round(quantile_cont(train_d1_median_freq, 0.5), 4) as median_freq from (select distinct id, role, train_d1_freq_lt20, train_d1_median_freq from health_gates_and_support) group by role")
def a17_support_profile(s, d):
    h = table(s, d, "health_gates_and_support", "id", "role", "train_d1_freq_lt20", "train_d1_median_freq").distinct()
    return h.groupBy("role").agg(F.count("*").alias("n"), F.sum((F.col("train_d1_freq_lt20") > 10000).cast("int")).alias("n_weak"), F.round(F.percentile("train_d1_median_freq", 0.5), 4).alias("median_freq"))


@query("select site, count(*) as n, round(avg((quality_tier = 'strict')::int), 4) as pass from build where site is not null and quality_tier is not null group by site having count(*) >= 5 and avg((quality_tier = 'strict')::int) < 0.7")
def a19_bad_sites(s, d):
    b = table(s, d, "build", "site", "quality_tier").where("site is not null and quality_tier is not null")
    g = b.groupBy("site").agg(F.count("*").alias("n"), F.avg((F.col("quality_tier") == "strict").cast("int")).alias("p"))
    return g.where("n >= 5 and p < 0.7").select("site", "n", F.round("p", 4).alias("pass"))


@query("select count(*) as rows, count(*) filter (where length(text) >= 200) as prefiltered, count(*) filter (where length(text) >= 200 and lang = 'hno') as hits from documents")
def a20_scan_counts(s, d):
    return table(s, d, "documents", "text", "lang").agg(F.count("*").alias("rows"), F.count_if(F.length("text") >= 200).alias("prefiltered"), F.count_if((F.length("text") >= 200) & (F.col("lang") == "hno")).alias("hits"))


@query(f"select w as word, count(distinct source) as n_groups from {_W} group by w having count(distinct source) >= 4")
def a21_group_vocabulary(s, d):
    return _w(s, d).select("w", "source").distinct().groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n_groups")).where("n_groups >= 4")


@query("with g as (select group_key, sum(n_words) as w from (select distinct uid, group_key, n_words from split_manifest) where n_words is not null group by group_key) select count(*) as n_groups, sum(w) as n_words, round(sum(w::double * w) / pow(sum(w), 2), 6) as herfindahl from g")
def a23_group_concentration(s, d):
    g = table(s, d, "split_manifest", "uid", "group_key", "n_words").distinct().where("n_words is not null").groupBy("group_key").agg(F.sum("n_words").cast("double").alias("w"))
    return g.agg(F.count("*").alias("n_groups"), F.sum("w").cast("bigint").alias("n_words"), F.round(F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), F.lit(2.0)), 6).alias("herfindahl"))


@query("with m as (select distinct uid, split, source from split_manifest), t as (select source, count(*)::double / (select count(*) from m) as p from m group by source), x as (select split, source, count(*)::double / sum(count(*)) over (partition by split) as q from m group by split, source) select split, round(sqrt(sum(pow(q - p, 2))), 6) as distance from x join t using (source) group by split")
def a24_composition_distance(s, d):
    m = table(s, d, "split_manifest", "uid", "split", "source").distinct()
    c = m.groupBy("split", "source").agg(F.count("*").alias("c"))
    t = c.groupBy("source").agg(F.sum("c").alias("tc")).crossJoin(F.broadcast(c.agg(F.sum("c").alias("all"))))
    q = c.join(c.groupBy("split").agg(F.sum("c").alias("sc")), "split").join(t, "source")
    return q.groupBy("split").agg(F.round(F.sqrt(F.sum(F.pow(F.col("c") / F.col("sc") - F.col("tc") / F.col("all"), F.lit(2.0)))), 6).alias("distance"))


@query("with b as (select candidate, seed, sum(bits) / sum(bytes) as bpb from (select distinct * from bits_records where bits is not null) group by 1, 2), r as (select candidate, stddev_samp(bpb) / avg(bpb) as rsd from b group by candidate having count(*) > 1) select round(sqrt(avg(rsd * rsd)), 6) as pooled_rsd, count(*) as n from r")
def a25_pooled_sd(s, d):
    b = table(s, d, "bits_records").where("bits is not null").distinct().groupBy("candidate", "seed").agg((F.sum("bits") / F.sum("bytes")).alias("bpb"))
    r = b.groupBy("candidate").agg((F.stddev_samp("bpb") / F.avg("bpb")).alias("rsd"), F.count("*").alias("k")).where("k > 1")
    return r.agg(F.round(F.sqrt(F.avg(F.col("rsd") * F.col("rsd"))), 6).alias("pooled_rsd"), F.count("*").alias("n"))


@query("with u as (select count(*) as rows_in, count(distinct uid) as uids from build) select rows_in, uids as kept, rows_in - uids as repeated, (rows_in = uids + (rows_in - uids)) as conserved from u")
def a26_conservation(s, d):
    u = table(s, d, "build", "uid").agg(F.count("*").alias("rows_in"), F.count_distinct("uid").alias("kept"))
    return u.select("rows_in", "kept", (F.col("rows_in") - F.col("kept")).alias("repeated"), (F.col("rows_in") == F.col("kept") + (F.col("rows_in") - F.col("kept"))).alias("conserved"))


@query("select extraction_method, count(*) as n, round(avg(script_fraction), 6) as mean_script from build group by extraction_method")
def a27_extraction_methods(s, d):
    return table(s, d, "build", "extraction_method", "script_fraction").groupBy("extraction_method").agg(F.count("*").alias("n"), F.round(F.avg("script_fraction"), 6).alias("mean_script"))


_RULES = {"kashida": "[\\x{0640}]", "zero_width": "[\\x{200b}\\x{200d}-\\x{200f}]", "harakat": "[\\x{064B}-\\x{065F}\\x{0670}]", "arabic_yeh_kaf": "[يك]"}


@query("with b as (select distinct uid, source, text from build where text is not null) " + " union all ".join(f"select source, '{k}' as rule, count(*) filter (where regexp_matches(text, '{v}')) as n_records, sum(length(text) - length(regexp_replace(text, '{v}', '', 'g'))) as n_chars from b group by source" for k, v in _RULES.items()))
def a29_normalization_impact(s, d):
    b = table(s, d, "build", "uid", "source", "text").where("text is not null").distinct()
    rules = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.regexp_count("text", F.lit(v))) for k, v in _RULES.items())))
    e = b.select("source", F.explode(rules).alias("rule", "k"))
    return e.groupBy("source", "rule").agg(F.count_if(F.col("k") > 0).alias("n_records"), F.sum("k").alias("n_chars"))


@query("with w as (select distinct w from (select unnest(regexp_extract_all(text, '[\\p{L}\\p{M}]+')) as w from build where text is not null)) select n as family_size, count(*) as n_families from (select regexp_replace(w, '\\p{M}', '', 'g') as bare, count(*) as n from w group by 1) group by n")
def a30_variant_families(s, d):
    w = table(s, d, "build", "text").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{M}]+"), F.lit(0))).alias("w")).distinct()
    f = w.groupBy(F.regexp_replace("w", r"\p{M}", "").alias("bare")).agg(F.count("*").alias("n"))
    return f.groupBy(F.col("n").alias("family_size")).agg(F.count("*").alias("n_families"))


@query("select book_folder, count(*) as n, sum(n_chars) as n_chars from (select distinct uid, book_folder, length(text) as n_chars from build where source = 'book') group by book_folder")
def a32_book_folders(s, d):
    b = table(s, d, "build", "uid", "book_folder", "text", "source").where("source = 'book'").select("uid", "book_folder", F.length("text").alias("n_chars")).distinct()
    return b.groupBy("book_folder").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"with c as (select w, count(*) as n, count(distinct source) as units from {_W} group by w) select case when regexp_matches(w, '^[0-9]+$') then 'digits' when units = 1 and n >= 20 then 'single_unit' when length(w) > 25 then 'long' else 'ok' end as flag, count(*) as n_pieces from c group by 1")
def a33_junk_flags(s, d):
    c = _w(s, d).groupBy("w").agg(F.count("*").alias("n"), F.count_distinct("source").alias("units"))
    flag = F.when(F.col("w").rlike("^[0-9]+$"), "digits").when((F.col("units") == 1) & (F.col("n") >= 20), "single_unit").when(F.length("w") > 25, "long").otherwise("ok")
    return c.groupBy(flag.alias("flag")).agg(F.count("*").alias("n_pieces"))


@query("with h as (select id, round(min(dev_fertility), 6) as f from health_gates_and_support where dev_fertility is not null and id is not null group by id) select id, f as fertility, rank() over (order by f) as rank, round((f / (select max(f) from h) - 1) * 100, 4) as pct from h")
def a34_w06_competitor_ranks(s, d):
    """One row per run; ranks come from the counts of distinct values, a far smaller table than the runs."""
    from pyspark.sql import Window

    h = table(s, d, "health_gates_and_support", "id", "dev_fertility").where("id is not null and dev_fertility is not null").groupBy("id").agg(F.round(F.min("dev_fertility"), 6).alias("f"))
    v = h.groupBy("f").agg(F.count("*").alias("c"))
    v = v.withColumn("rank", F.coalesce(F.sum("c").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).drop("c")
    top = h.agg(F.max("f").alias("top"))
    return h.join(v, "f").crossJoin(F.broadcast(top)).select("id", F.col("f").alias("fertility"), "rank", F.round((F.col("f") / F.col("top") - 1) * 100, 4).alias("pct"))


@query("with x as (select split, quality_tier, group_key, count(*) as n from (select distinct uid, split, quality_tier, group_key from split_manifest) group by all) select split, quality_tier, sum(n) as n_records, count(distinct group_key) as n_clusters, max(n) as largest from x group by 1, 2")
def a35_split_sizes(s, d):
    x = table(s, d, "split_manifest", "uid", "split", "quality_tier", "group_key").distinct().groupBy("split", "quality_tier", "group_key").agg(F.count("*").alias("n"))
    return x.groupBy("split", "quality_tier").agg(F.sum("n").alias("n_records"), F.count("group_key").alias("n_clusters"), F.max("n").alias("largest"))
