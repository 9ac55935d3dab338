"""Joins, sorts, set operations, arrays, maps and JSON over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..io import table
from ..session import cut
from .catalog import query


@query("select m.split, b.source, count(distinct b.uid) as n_records, sum(b.same::int) as n_same_source from (select distinct uid, source from build) x join (select uid, source, true as same from build) b using (uid, source) join (select distinct uid, split, source from split_manifest) m on m.uid = b.uid and m.source = b.source group by 1, 2")
def j01_manifest_join(s, d):
    b = table(s, d, "build", "uid", "source")
    m = table(s, d, "split_manifest", "uid", "split", "source").distinct()
    return b.join(m, ["uid", "source"]).groupBy("split", "source").agg(F.count_distinct("uid").alias("n_records"), F.count("*").alias("n_same_source"))


@query("select count(*) as n_strict, count(*) filter (where uid in (select uid from build where quality_tier in ('strict', 'permissive'))) as n_subset from (select distinct uid from build where quality_tier = 'strict')")
def j02_strict_subset(s, d):
    b = table(s, d, "build", "uid", "quality_tier")
    strict = b.where("quality_tier = 'strict'").select("uid").distinct()
    keep = b.where("quality_tier in ('strict', 'permissive')").select("uid", F.lit(1).alias("hit")).distinct()
    return strict.join(keep, "uid", "left").agg(F.count("*").alias("n_strict"), F.count("hit").alias("n_subset"))


@query("select uid, 'missing' as side from (select uid from split_manifest except select uid from bits_records) union all select uid, 'added' from (select uid from bits_records except select uid from split_manifest)")
def j03_anti_joins(s, d):
    m, b = table(s, d, "split_manifest", "uid").distinct(), table(s, d, "bits_records", "uid").distinct()
    return m.join(b, "uid", "left_anti").select("uid", F.lit("missing").alias("side")).unionByName(b.join(m, "uid", "left_anti").select("uid", F.lit("added").alias("side")))


_FIRST_LAST = "(select uid, arg_min(quality_tier, (emitted_at, id)) as t1, arg_max(quality_tier, (emitted_at, id)) as t2 from (select uid, coalesce(quality_tier, '-') as quality_tier, emitted_at, id from build) group by uid)"


@query(f"select count(*) as n, count(*) filter (where t1 <> t2) as tier_changed from {_FIRST_LAST}")
def j04_release_diff(s, d):
    b = table(s, d, "build", "uid", "id", "quality_tier", "emitted_at").withColumn("t", F.coalesce("quality_tier", F.lit("-")))
    k = F.struct("emitted_at", "id")
    first = b.groupBy("uid").agg(F.min_by("t", k).alias("t1"))
    last = b.groupBy("uid").agg(F.max_by("t", k).alias("t2"))
    x = first.join(last, "uid", "full_outer")
    return x.agg(F.count("*").alias("n"), F.count_if(~F.col("t1").eqNullSafe(F.col("t2"))).alias("tier_changed"))


POLICIES = (("web_khabarnama_hazar", "news"), ("web_kohsar_forum", "forum"), ("web_chinar_adab", "literary"))


@query("select coalesce(p.kind, 'OTHER') as kind, count(*) as n from build b left join (values " + ", ".join(f"('{a}', '{b}')" for a, b in POLICIES) + ") p(site, kind) using (site) where b.source = 'web' group by 1")
def j05_f17_lookup_with_default(s, d):
    p = s.createDataFrame(POLICIES, "site string, kind string")
    b = table(s, d, "build", "site", "source").where("source = 'web'")
    return b.join(F.broadcast(p), "site", "left").groupBy(F.coalesce("kind", F.lit("OTHER")).alias("kind")).agg(F.count("*").alias("n"))


@query("select candidate, arg_min(uid, (-b, uid)) as uid, max(b) as bits from (select distinct candidate, uid, round(bits, 3) as b from bits_records where bits is not null) group by candidate")
def j12_o03_best_match(s, d):
    b = table(s, d, "bits_records", "candidate", "uid", "bits").where("bits is not null").select("candidate", "uid", F.round("bits", 3).alias("b")).distinct()
    return b.groupBy("candidate").agg(F.min_by("uid", F.struct(-F.col("b"), "uid")).alias("uid"), F.max("b").alias("bits"))


@query("with k as (select distinct source_path, lower(trim(regexp_replace(regexp_replace(source_path, '[\\\\/]+', '/', 'g'), '\\.[^.]*$', ''))) as stem from build where source_path is not null) select stem, count(*) as n, min(source_path) as first_path from k group by stem having count(*) > 1")
def j14_stem_twins(s, d):
    k = table(s, d, "build", "source_path").where("source_path is not null").distinct()
    stem = F.lower(F.trim(F.regexp_replace(F.regexp_replace("source_path", r"[\\/]+", "/"), r"\.[^.]*$", "")))
    return k.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.min("source_path").alias("first_path")).where("n > 1")


_FOLD = "regexp_replace(lower(regexp_replace(source_path, '[\\\\/]+', '/', 'g')), '/[^/]*$', '')"


@query(f"with f as (select {_FOLD} as folder, date, date_precision from build where source_path is not null), u as (select folder, min(date) as day from f where date_precision = 'day' and date is not null group by folder having count(distinct date) = 1) select folder, day, count(*) as n_filled from f join u using (folder) where f.date is null group by folder, day")
def j15_sibling_dates(s, d):
    b = table(s, d, "build", "source_path", "date", "date_precision").where("source_path is not null")
    f = b.withColumn("folder", F.regexp_replace(F.lower(F.regexp_replace("source_path", r"[\\/]+", "/")), "/[^/]*$", ""))
    u = f.where("date_precision = 'day' and date is not null").groupBy("folder").agg(F.count_distinct("date").alias("k"), F.min("date").alias("day")).where("k = 1")
    return f.where("date is null").join(u.select("folder", "day"), "folder").groupBy("folder", "day").agg(F.count("*").alias("n_filled"))


@query("select a.candidate as a, b.candidate as b, count(*) as n, round(sum(a.bits) / sum(b.bits), 6) as ratio from (select distinct * from bits_records where bits is not null) a join (select distinct * from bits_records where bits is not null) b on a.uid = b.uid and a.seed = b.seed and a.candidate < b.candidate group by 1, 2")
def j16_j17_candidate_alignment(s, d):
    b = table(s, d, "bits_records").where("bits is not null").distinct()
    x = b.select("uid", "seed", F.col("candidate").alias("a"), F.col("bits").alias("ba"))
    y = b.select("uid", "seed", F.col("candidate").alias("b"), F.col("bits").alias("bb"))
    return x.join(y, ["uid", "seed"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum("ba") / F.sum("bb"), 6).alias("ratio"))


_WORDS = "(select w, count(*) as n from (select unnest(regexp_extract_all(text, '[\\p{L}]+')) as w from documents where text is not null) group by w)"


@query(f"with v as (select * from {_WORDS}) select a.w as word, b.w as variant, least(a.n, b.n) as least_count from v a join v b on b.w = replace(a.w, 'ے', 'ی') and a.w <> b.w where least(a.n, b.n) >= 2")
def j18_word_variants(s, d):
    v = _word_counts(s, d)
    b = v.select(F.col("w").alias("variant"), F.col("n").alias("n2"))
    a = v.withColumn("variant", F.translate("w", "ے", "ی")).where("variant <> w")
    return a.join(b, "variant").select(F.col("w").alias("word"), "variant", F.least("n", "n2").alias("least_count")).where("least_count >= 2")


def _word_counts(s, d):
    t = table(s, d, "documents", "text").where("text is not null")
    return t.select(F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


SUFFIXES = ("اں", "ی", "ے", "نال")


@query(f"with v as (select * from {_WORDS} where n >= 3) select a.w as stem, count(*) as n_cells, sum(b.n) as n_forms from v a, (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in SUFFIXES)}) s(x) join v b on b.w = a.w || s.x group by a.w")
def j19_paradigm_cells(s, d):
    v = _word_counts(s, d).where("n >= 3")
    cells = v.select(F.col("w").alias("stem"), F.explode(F.array(*(F.lit(x) for x in SUFFIXES))).alias("x")).withColumn("w", F.concat("stem", "x"))
    return cells.join(v, "w").groupBy("stem").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_forms"))


@query("select p.name as perturbation, count(*) as n, sum(length(case p.name when 'digits' then translate(text, '۰۱۲۳۴۵۶۷۸۹', '0123456789') when 'zwnj' then replace(text, chr(8204), '') else text end)) as n_chars from documents, (values ('none'), ('digits'), ('zwnj')) p(name) where text is not null group by 1")
def j20_cross_perturbations(s, d):
    p = s.createDataFrame([("none",), ("digits",), ("zwnj",)], "name string")
    t = table(s, d, "documents", "text").where("text is not null").crossJoin(F.broadcast(p))
    x = F.when(F.col("name") == "digits", F.translate("text", "۰۱۲۳۴۵۶۷۸۹", "0123456789")).when(F.col("name") == "zwnj", F.replace("text", F.lit("‌"), F.lit(""))).otherwise(F.col("text"))
    return t.groupBy(F.col("name").alias("perturbation")).agg(F.count("*").alias("n"), F.sum(F.length(x)).alias("n_chars"))


@query("select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderstatus = 'F' group by n_name")
def j_star_join(s, d):
    o = table(s, d, "orders", "o_custkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'")
    c, n, r = table(s, d, "customer", "c_custkey", "c_nationkey"), table(s, d, "nation"), table(s, d, "region", "r_regionkey")
    x = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return x.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def j_pricing_summary(s, d):
    l = table(s, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


@query("select c_mktsegment, count(distinct o_orderkey) as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey group by 1")
def j_segment_revenue(s, d):
    c, o, l = table(s, d, "customer", "c_custkey", "c_mktsegment"), table(s, d, "orders", "o_orderkey", "o_custkey"), table(s, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey)
    return x.groupBy("c_mktsegment").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select uid, id, row_number() over (order by source, source_path, id, uid) as seq from (select distinct uid, id, coalesce(source, '') as source, coalesce(source_path, '') as source_path from build)")
def o01_o08_ordered_ids(s, d):
    """Sequential ids over a total order: positions are counted per range partition and offset, not in one task."""
    b = table(s, d, "build", "uid", "id", "source", "source_path").select("uid", "id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("source_path", F.lit("")).alias("source_path")).distinct()
    order = ["source", "source_path", "id", "uid"]
    part = b.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    # Written once, so that both uses below see the same partitions.
    part = cut(part.withColumn("at", F.col("m") - F.shiftleft(F.col("p").cast("bigint"), 33)))
    sizes = part.groupBy("p").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    return part.join(F.broadcast(offsets), "p").select("uid", "id", (F.col("before") + F.col("at") + 1).alias("seq"))


@query("select source, count(*) as n from build group by source order by n desc, source limit 2")
def o02_o07_top_k(s, d):
    return table(s, d, "build", "source").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(2)


@query("select 'documents' as part, count(*) as n, sum(length(text)) as n_chars from documents union all select 'eval_items', count(*), sum(length(text)) from eval_items")
def o04_bag_union(s, d):
    a = table(s, d, "documents", "text").withColumn("part", F.lit("documents"))
    b = table(s, d, "eval_items", "text", "suite").withColumn("part", F.lit("eval_items"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("select uid from (select uid from split_manifest where split = 'test') intersect select uid from bits_records")
def o05_set_operations(s, d):
    return table(s, d, "split_manifest", "uid", "split").where("split = 'test'").select("uid").intersect(table(s, d, "bits_records", "uid"))


@query("select uid, arg_min(id, (emitted_at, id)) as id, count(*) as n_rows from build group by uid")
def o06_first_by_order(s, d):
    return table(s, d, "build", "uid", "id", "emitted_at").groupBy("uid").agg(F.min_by("id", F.struct("emitted_at", "id")).alias("id"), F.count("*").alias("n_rows"))


_CH = "(select ch, sum(n) as n from (select unnest(string_split(text, '')) as ch, 1 as n from {0} where text is not null) group by ch)"


@query(f"select coalesce(a.ch, b.ch) as ch, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) as added from {_CH.format('documents')} a full join {_CH.format('eval_items')} b on a.ch = b.ch where coalesce(a.n, 0) <> coalesce(b.n, 0) and coalesce(a.ch, b.ch) <> ''")
def o09_multiset_difference(s, d):
    def chars(name, col):
        t = table(s, d, name, "text").where("text is not null")
        return t.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias(col))

    x = chars("documents", "a").join(chars("eval_items", "b"), "ch", "full").select("ch", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return x.where("a <> b").select("ch", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))





@query("with c as (select doc_id, category, count(*) as n from content_labels where category is not null group by 1, 2) select doc_id, arg_max(category, (n, category)) as top, round(max(n)::double / sum(n), 4) as share from c group by doc_id")
def m01_max_key_of_map(s, d):
    c = table(s, d, "content_labels", "doc_id", "category").where("category is not null").groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    m = c.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return m.select("doc_id", best["k"].alias("top"), F.round(best["n"] / total, 4).alias("share"))


@query("select uid, case when max(s) >= 0.7 then 'hindko' when min(s) <= 0.3 then 'urdu' else 'mixed' end as decision from (select uid, hindko_score as s from build where hindko_score is not null) group by uid")
def m02_language_decision(s, d):
    g = table(s, d, "build", "uid", "hindko_score").where("hindko_score is not null").groupBy("uid").agg(F.map_from_arrays(F.array(F.lit("hi"), F.lit("lo")), F.array(F.max("hindko_score"), F.min("hindko_score"))).alias("p"))
    return g.select("uid", F.when(F.element_at("p", "hi") >= 0.7, "hindko").when(F.element_at("p", "lo") <= 0.3, "urdu").otherwise("mixed").alias("decision"))


@query("select k as placeholder, sum(v) as n from (select unnest(map_keys(pii_masked)) as k, unnest(map_values(pii_masked)) as v from build where pii_masked is not null) group by k")
def m03_map_sums(s, d):
    return table(s, d, "build", "pii_masked").where("pii_masked is not null").select(F.explode("pii_masked").alias("placeholder", "v")).groupBy("placeholder").agg(F.sum("v").alias("n"))


@query("select id, uid, len(list_concat(coalesce(quality_flags, []), coalesce(content_flags, []))) as n_flags from (select distinct id, uid, quality_flags, content_flags from build)")
def m04_flag_concat(s, d):
    b = table(s, d, "build", "id", "uid", "quality_flags", "content_flags").distinct()
    e = F.array().cast("array<string>")
    return b.select("id", "uid", F.size(F.concat(F.coalesce("quality_flags", e), F.coalesce("content_flags", e))).alias("n_flags"))


@query("select event_type, count(*) as n, count(json_extract_string(props, '$.page')) as n_page, count(distinct props) as n_props from events group by event_type")
def m05_json_props(s, d):
    e = table(s, d, "events", "event_type", "props")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.page")).alias("n_page"), F.count_distinct("props").alias("n_props"))


@query("select count(*) as n, count(case when isnan(x) or isinf(x) then null else x end) as n_finite from (select train_d1_freq_lt20_pct as x from health_gates_and_support)")
def m06_nan_to_null(s, d):
    x = F.col("train_d1_freq_lt20_pct")
    return table(s, d, "health_gates_and_support", "train_d1_freq_lt20_pct").agg(F.count("*").alias("n"), F.count(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)).alias("n_finite"))


@query("with f as (select uid, coalesce(quality_flags, []) as a, coalesce(content_flags, []) as b from (select distinct uid, quality_flags, content_flags from build)) select sum(len(list_intersect(a, b))) as n_both, sum(len(list_distinct(list_concat(a, b)))) as n_either from f")
def m07_array_sets(s, d):
    e = F.array().cast("array<string>")
    f = table(s, d, "build", "uid", "quality_flags", "content_flags").distinct().select(F.coalesce("quality_flags", e).alias("a"), F.coalesce("content_flags", e).alias("b"))
    return f.agg(F.sum(F.size(F.array_intersect("a", "b"))).alias("n_both"), F.sum(F.size(F.array_union("a", "b"))).alias("n_either"))


@query("select b.uid, b.source, b.quality_tier from (select distinct uid, source, quality_tier from build) b join (select distinct uid from split_manifest where split = 'validation') m using (uid) where b.source in ('book', 'newspaper') and b.quality_tier = 'strict'")
def f18_split_filter(s, d):
    m = table(s, d, "split_manifest", "uid", "split").where("split = 'validation'").select("uid").distinct()
    b = table(s, d, "build", "uid", "source", "quality_tier").where("source in ('book', 'newspaper') and quality_tier = 'strict'").distinct()
    return b.join(m, "uid", "left_semi")


@query("select count(distinct uid) as n_refused from bits_records where uid in (select uid from split_manifest where split = 'test')")
def f19_test_refusal(s, d):
    t = table(s, d, "split_manifest", "uid", "split").where("split = 'test'").select("uid").distinct()
    return table(s, d, "bits_records", "uid").join(t, "uid", "left_semi").agg(F.count_distinct("uid").alias("n_refused"))


@query("select lower(regexp_replace(url, '/+$', '')) as url, arg_max(doc_id, (fetched_at, doc_id)) as doc_id, count(*) as n from documents where url is not null group by 1")
def s16_latest_capture(s, d):
    x = table(s, d, "documents", "url", "doc_id", "fetched_at").where("url is not null")
    return x.groupBy(F.lower(F.regexp_replace("url", "/+$", "")).alias("url")).agg(F.max_by("doc_id", F.struct("fetched_at", "doc_id")).alias("doc_id"), F.count("*").alias("n"))


@query("select sha1(url || '?' || coalesce(source, '')) as key, count(*) as n from documents where url is not null group by 1")
def s17_replay_keys(s, d):
    return table(s, d, "documents", "url", "source").where("url is not null").groupBy(F.sha1(F.concat("url", F.lit("?"), F.coalesce("source", F.lit("")))).alias("key")).agg(F.count("*").alias("n"))


@query("select lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) as ext, count(*) as n, round(avg(n_chars), 4) as mean_chars from build where source_file is not null group by 1")
def s19_inventory(s, d):
    b = table(s, d, "build", "source_file", "n_chars").where("source_file is not null")
    return b.groupBy(F.lower(F.regexp_extract("source_file", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("select site, url, id from (select site, url, id, row_number() over (partition by site, url order by emitted_at, id) as rn from (select distinct site, url, id, emitted_at from build where site is not null and url is not null)) where rn = 1")
def s10_site_page_union(s, d):
    b = table(s, d, "build", "site", "url", "id", "emitted_at").where("site is not null and url is not null").distinct()
    return b.groupBy("site", "url").agg(F.min_by("id", F.struct("emitted_at", "id")).alias("id"))
