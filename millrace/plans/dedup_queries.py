"""Deduplication, containment, decontamination and repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..io import table
from ..operators.broadcast import bounded, shuffled
from ..operators.graph import components
from ..operators.minhash import near_duplicates
from ..session import cut
from .catalog import query
from .text_queries import LEAK_SQL

#: Grams in fewer or more records than these join no pairs (a rule of the measure, not a shortcut).
DF_MIN, DF_MAX = 2, 50
GRAM, MIN_GRAMS, CONTAINED = 8, 5, 0.80
#: So many of a record's rarest grams are joined before the bound on the others is known; it changes the cost only.
FIRST = 6


def _docs(s, d):
    return table(s, d, "documents", "doc_id", "text", "source").where("text is not null")


@query("select doc_id, min(doc_id) over (partition by sha256(regexp_replace(text, '\\s+', ' ', 'g'))) as duplicate_of from documents where text is not null")
def d01_exact_dedup(s, d):
    x = _docs(s, d).select("doc_id", F.sha2(F.regexp_replace("text", r"\s+", " "), 256).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("duplicate_of"))
    return x.join(first, "h").select("doc_id", "duplicate_of")


@query()
def d03_minhash_near_duplicates(s, d):
    return near_duplicates(table(s, d, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("ord", "doc_id")


def grams(docs, key: str, n: int = GRAM):
    """(key, gram): distinct hashed runs of n folded words."""
    return docs.select(key, F.explode(F.array_distinct(T.gram_hashes(T.leak_words(F.col("text")), n))).alias("gram"))


def _grams_sql(tab: str, key: str, n: int = GRAM, extra: str = "") -> str:
    return (
        f"select distinct {key}, hash(array_to_string(w[i:i + {n - 1}], ' ')) as gram from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i "
        f"from (select {key}, {LEAK_SQL.format('text')} as w from {tab} where text is not null {extra}))"
    )


@query(f"""with g as ({_grams_sql('documents', 'doc_id')}), n as (select doc_id, count(*) as n from g group by doc_id),
df as (select gram from g group by gram having count(*) between {DF_MIN} and {DF_MAX}), k as (select g.* from g join df using (gram)),
p as (select a.doc_id as small, b.doc_id as big, count(*) as shared from k a join k b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
c as (select small, big, shared::double / x.n as cont from p join n x on x.doc_id = small join n y on y.doc_id = big where x.n >= {MIN_GRAMS} and (y.n > x.n or (y.n = x.n and big < small)))
select small as doc_id, arg_min(big, (-cont, big)) as container, round(max(cont), 4) as containment from c where cont >= {CONTAINED} group by small""")
def d05_containment(s, d):
    g = cut(grams(_docs(s, d), "doc_id"))
    n = g.groupBy("doc_id").agg(F.count("*").alias("n"))
    df = g.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df").between(DF_MIN, DF_MAX)).select("gram")
    k = g.join(df, "gram", "left_semi")
    a, b = k.withColumnRenamed("doc_id", "small"), k.withColumnRenamed("doc_id", "big")
    p = a.join(b, "gram").where("small <> big").groupBy("small", "big").agg(F.count("*").alias("shared"))
    x, y = n.select(F.col("doc_id").alias("small"), F.col("n").alias("n1")), n.select(F.col("doc_id").alias("big"), F.col("n").alias("n2"))
    c = p.join(x, "small").join(y, "big").where((F.col("n1") >= MIN_GRAMS) & ((F.col("n2") > F.col("n1")) | (F.col("n2") == F.col("n1")) & (F.col("big") < F.col("small"))))
    c = c.withColumn("cont", F.col("shared") / F.col("n1")).where(F.col("cont") >= CONTAINED)
    return c.groupBy(F.col("small").alias("doc_id")).agg(F.min_by("big", F.struct(-F.col("cont"), "big")).alias("container"), F.round(F.max("cont"), 4).alias("containment"))


_GROUPED = "(select b.uid, min(m.group_key) as grp, min(b.text) as text from build b join split_manifest m using (uid) group by b.uid)"


def _grouped(s, d):
    b = table(s, d, "build", "uid", "text").groupBy("uid").agg(F.min("text").alias("text"))
    m = table(s, d, "split_manifest", "uid", "group_key", "split").groupBy("uid").agg(F.min("group_key").alias("grp"), F.min("split").alias("split"))
    return b.join(m, "uid").where("text is not null")


@query(f"""with t as {_GROUPED}, g as ({_grams_sql('t', 'uid, grp')}), many as (select gram from g group by gram having count(distinct grp) >= 2)
select uid, count(*) as n_grams, round(avg((many.gram is not null)::int), 4) as contained from g left join many using (gram) group by uid""")
def d06_group_containment(s, d):
    g = cut(_grouped(s, d).select("uid", "grp", F.explode(F.array_distinct(T.gram_hashes(T.leak_words(F.col("text")), GRAM))).alias("gram")))
    many = g.select("gram", "grp").distinct().groupBy("gram").agg(F.count("*").alias("k")).where("k >= 2").select("gram", F.lit(1).alias("hit"))
    return g.join(many, "gram", "left").groupBy("uid").agg(F.count("*").alias("n_grams"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("contained"))


_SPLIT = "(select b.uid, min(m.split) as split, min(b.text) as text from build b join split_manifest m using (uid) group by b.uid)"


def met_in_train(records: DataFrame) -> DataFrame:
    """(split, gram, n, hit): the distinct grams of the records outside train, counted by split; hit is 1 where train has the
    gram, else null. The row without a gram counts a split's records with grams. records: (split, grams), one row each."""
    every = T.let(F.array_distinct("grams"), lambda g: F.when(F.size(g) > 0, F.concat(F.array(F.lit(None).cast("bigint")), g)))
    tr = records.where("split = 'train'").select(F.explode("grams").alias("gram")).distinct().withColumn("hit", F.lit(1))
    e = records.where("split <> 'train'").select("split", F.explode(every).alias("gram")).groupBy("split", "gram").agg(F.count("*").alias("n"))
    return e.join(shuffled(tr), "gram", "left")


@query(f"""with t as {_SPLIT}, g as ({_grams_sql('t', 'uid, split')}), tr as (select distinct gram from g where split = 'train')
select split, count(distinct uid) as n_records, round(avg((tr.gram is not null)::int), 4) as contained from g left join tr using (gram) where split <> 'train' group by split""")
def d07_eval_containment(s, d):
    e = met_in_train(_grouped(s, d).select("split", T.gram_hashes(T.leak_words(F.col("text")), GRAM).alias("grams")))
    rows, hits = F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0))
    return e.groupBy("split").agg(F.sum(F.when(F.col("gram").isNull(), F.col("n"))).alias("n_records"), F.round(hits / rows, 4).alias("contained"))


@query(f"""with t as {_SPLIT}, g as ({_grams_sql('t', 'uid, split')}), n as (select uid, count(*) as n from g group by uid), e as (select * from g where split <> 'train'),
p as (select e.uid, t.uid as partner, count(*) as c from e join g t on t.gram = e.gram and t.split = 'train' group by 1, 2), j as (select p.uid, partner, c::double / (x.n + y.n - c) as j from p join n x on x.uid = p.uid join n y on y.uid = p.partner)
select uid, arg_min(partner, (-j, partner)) as partner, round(max(j), 4) as jaccard from j group by uid""")
def d07_best_partner(s, d):
    """Of every evaluation record the train record with the highest Jaccard similarity of word runs, ties by uid."""
    x, grams = _grouped(s, d), T.array_distinct_sized(T.gram_hashes(T.leak_words(F.col("text")), GRAM))
    return best_partners(*(x.where(side).select("uid", F.explode(grams).alias("x")).select("uid", "x.*") for side in ("split <> 'train'", "split = 'train'")))


def best_partners(records: DataFrame, others: DataFrame, first: int = FIRST) -> DataFrame:
    """(uid, partner, jaccard) of every record that shares a gram with one of the others: the most similar one, ties by uid.
    Both: (uid, gram, n), the distinct grams of each record, n their number.

    Only the grams that both sides have count. Others with the same such grams are one class, named by its shortest member,
    records with the same ones and the same length another. A record meets the classes that have one of its first, rarest
    grams; the best of them, of similarity j, sets how many grams a better one shares at least (j n of the record's n), so
    that one has one of the rarest rest + 1. Those are met as well, and every class met is compared exactly.
    """
    o = cut(others.join(shuffled(records.select("gram").distinct()), "gram", "left_semi"))
    r = records.join(shuffled(o.select("gram").distinct()), "gram", "left_semi")
    r, o = (x.groupBy("uid").agg(F.array_sort(F.collect_list("gram")).alias("b"), F.max("n").alias("n")) for x in (r, o))
    o = cut(o.groupBy("b").agg(F.min(F.struct("n", "uid")).alias("least")).select(F.col("least.uid").alias("partner"), F.col("least.n").alias("m"), F.col("b").alias("c")))
    r = cut(r.withColumn("set", F.xxhash64("b")))
    classes = cut(r.groupBy("set", "n").agg(F.min(F.struct("uid", "b")).alias("one")).select(F.col("one.uid").alias("class"), "set", "n", "one.b"))
    there = o.select("partner", "m", F.size("c").alias("k2"), F.explode("c").alias("gram"))
    df = shuffled(cut(there.groupBy("gram").agg(F.count("*").alias("df"))))
    ranks = lambda x, key: F.row_number().over(Window.partitionBy(key).orderBy("df", "gram"))
    there = there.join(df, "gram")
    there = cut(there.select("gram", "partner", "m", (F.col("k2") - ranks(there, "partner") + 1).alias("left2")))
    ranked = classes.select("class", "n", F.size("b").alias("k"), F.explode("b").alias("gram")).join(df, "gram")
    ranked = ranked.withColumn("rank", ranks(ranked, "class"))
    ranked = cut(ranked.select("gram", "class", "n", "rank", (F.col("k") - F.col("rank") + 1).alias("left")))
    own, theirs = shuffled(classes.select("class", "b")), shuffled(o.select("partner", "c"))

    def best(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("b", "c"))
        j = pairs.select("class", "n", "partner", "m").distinct().join(theirs, "partner").join(own, "class").select("class", "partner", (both / (F.col("n") + F.col("m") - both)).alias("j"))
        return j.groupBy("class").agg(F.min(F.struct((-F.col("j")).alias("j"), "partner")).alias("best"))

    near = cut(best(ranked.where(F.col("rank") <= first).join(shuffled(there), "gram")))
    rest = ranked.where(F.col("rank") > first).join(shuffled(near.select("class", (-F.col("best.j")).alias("j"))), "class")
    rest = rest.where(F.col("left") + 1e-6 >= F.col("j") * F.col("n")).join(shuffled(there), "gram")
    rest = rest.where(F.least("left", "left2") * (1 + F.col("j")) + 1e-6 >= F.col("j") * (F.col("n") + F.col("m")))
    found = near.unionByName(best(rest)).groupBy("class").agg(F.min("best").alias("best"))
    of = r.select("uid", "set", "n").join(shuffled(classes.select("class", "set", "n")), ["set", "n"])
    return of.join(shuffled(found), "class").select("uid", "best.partner", F.round(-F.col("best.j"), 4).alias("jaccard"))


@query()
def d08_leak_prone_fixpoint(s, d):
    """Records outside train of whose grams a share of 0.3 or more is in another group outside the split or in a
    leak-prone record; repeated until no record joins."""
    g = cut(_grouped(s, d).select("uid", "grp", "split", F.explode(F.array_distinct(T.gram_hashes(T.leak_words(F.col("text")), GRAM))).alias("gram")))
    n = g.where("split <> 'train'").groupBy("uid").agg(F.count("*").alias("n"))
    prone = cut(g.where("split = 'train'").select("uid").distinct())
    found = None
    while True:
        src = g.join(prone, "uid", "left_semi").select("gram", "grp").distinct().withColumnRenamed("grp", "other")
        hit = g.where("split <> 'train'").join(src, "gram").where("grp <> other").select("uid", "gram").distinct().groupBy("uid").agg(F.count("*").alias("k"))
        now = cut(hit.join(n, "uid").where("k >= 0.3 * n").select("uid"))
        if found is not None and now.count() == found.count():
            return now
        found = now
        prone = cut(prone.unionByName(now).distinct())


@query(f"""with i as ({_grams_sql('eval_items', 'item_id')}), c as (select distinct gram from ({_grams_sql('documents', 'doc_id')}))
select item_id, count(*) as n_grams, round(avg((c.gram is not null)::int), 4) as overlap from i left join c using (gram) group by item_id""")
def d09_eval_overlap_words(s, d):
    i = grams(table(s, d, "eval_items", "item_id", "text"), "item_id")
    c = grams(_docs(s, d), "doc_id").join(bounded(cut(i.select("gram").distinct())), "gram", "left_semi").select("gram").distinct().withColumn("hit", F.lit(1))
    return i.join(c, "gram", "left").groupBy("item_id").agg(F.count("*").alias("n_grams"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("overlap"))


@query("""with l as (select distinct m.split, b.uid, unnest(string_split(b.text, chr(10))) as l from build b join split_manifest m using (uid)), k as (select distinct split, l from l where length(l) >= 40)
select e.split, count(*) as n_lines, count(t.l) as n_leaked, round(sum(case when t.l is not null then strlen(e.l) else 0 end)::double / sum(strlen(e.l)), 4) as byte_share
from k e left join (select l from k where split = 'train') t using (l) where e.split <> 'train' group by e.split""")
def d10_line_leak_audit(s, d):
    b = table(s, d, "build", "uid", "text").where("text is not null").join(table(s, d, "split_manifest", "uid", "split").distinct(), "uid")
    k = b.select("split", F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 40).distinct()
    t = k.where("split = 'train'").select("l", F.lit(1).alias("hit"))
    e = k.where("split <> 'train'").join(t, "l", "left")
    return e.groupBy("split").agg(F.count("*").alias("n_lines"), F.count("hit").alias("n_leaked"), F.round(F.sum(F.when(F.col("hit") == 1, F.octet_length("l")).otherwise(0)) / F.sum(F.octet_length("l")), 4).alias("byte_share"))


_KEY = "regexp_replace(regexp_replace(l, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""with u as (select uid, min(text) as text, min(source) as src from build group by uid), l as (select distinct uid, src, {_KEY} as k from (select uid, src, unnest(string_split(text, chr(10))) as l from u)),
n as (select src, count(*) as n from u group by src) select l.src, k as line, count(*) as n_docs from l join n using (src) where length(k) between 1 and 60 group by l.src, k, n.n having count(*) >= greatest(12, 0.25 * n.n)""")
def d12_boilerplate_lines(s, d):
    u = table(s, d, "build", "uid", "text", "source").groupBy("uid").agg(F.min("text").alias("text"), F.min("source").alias("src"))
    l = u.select("uid", "src", F.explode(F.split("text", "\n")).alias("l")).select("uid", "src", T.line_key(F.col("l")).alias("line")).where(F.length("line").between(1, 60)).distinct()
    c = l.groupBy("src", "line").agg(F.count("*").alias("n_docs")).where("n_docs >= 12")
    n = u.groupBy("src").agg(F.count("*").alias("n"))
    return c.join(n, "src").where("n_docs >= 0.25 * n").select("src", "line", "n_docs")


@query(f"""with u as (select uid, min(text) as text, min(site) as site from build where site is not null group by uid), l as (select distinct uid, site, {_KEY} as k from (select uid, site, unnest(string_split(text, chr(10))) as l from u)),
n as (select site, count(*) as n from u group by site having count(*) >= 5) select site, count(*) as n_lines, max(c) as most from (select l.site, k, count(*) as c, any_value(n.n) as n from l join n using (site) where length(k) between 1 and 200 group by l.site, k) where c >= greatest(3, 0.1 * n) group by site""")
def d13_site_furniture(s, d):
    u = table(s, d, "build", "uid", "text", "site").where("site is not null").groupBy("uid").agg(F.min("text").alias("text"), F.min("site").alias("site"))
    l = u.select("uid", "site", F.explode(F.split("text", "\n")).alias("l")).select("uid", "site", T.line_key(F.col("l")).alias("k")).where(F.length("k").between(1, 200)).distinct()
    n = u.groupBy("site").agg(F.count("*").alias("n")).where("n >= 5")
    c = l.groupBy("site", "k").agg(F.count("*").alias("c")).where("c >= 3").join(n, "site").where("c >= 0.1 * n")
    return c.groupBy("site").agg(F.count("*").alias("n_lines"), F.max("c").alias("most"))


@query("""with l as (select distinct source, coalesce(issue, book_folder, site, '') as unit, unnest(string_split(text, chr(10))) as l from build) select source, l as line, count(*) as n_units from l where l <> '' group by source, l having count(*) >= 3""")
def d14_unit_boilerplate(s, d):
    b = table(s, d, "build", "source", "issue", "book_folder", "site", "text")
    l = b.select("source", F.coalesce("issue", "book_folder", "site", F.lit("")).alias("unit"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").distinct()
    return l.groupBy("source", "line").agg(F.count("*").alias("n_units")).where("n_units >= 3")


@query("""with u as (select uid, min(text) as text from build where text is not null group by uid), l as (select uid, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as l from u),
g as (select *, sum((l is distinct from prev)::int) over (partition by uid order by pos) as run from (select *, lag(l) over (partition by uid order by pos) as prev from l))
select uid, count(*) as n_runs, max(n) as longest from (select uid, run, count(*) as n from g where l <> '' group by uid, run) where n >= 2 group by uid""")
def d15_w05_line_stacks(s, d):
    u = table(s, d, "build", "uid", "text").where("text is not null").groupBy("uid").agg(F.min("text").alias("text"))
    l = u.select("uid", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    w = Window.partitionBy("uid").orderBy("pos")
    g = l.withColumn("run", F.sum((~F.col("l").eqNullSafe(F.lag("l").over(w))).cast("int")).over(w))
    r = g.where("l <> ''").groupBy("uid", "run").agg(F.count("*").alias("n")).where("n >= 2")
    return r.groupBy("uid").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


@query("""with u as (select uid, min(text) as text, min(source) as source from build group by uid), l as (select uid, source, unnest(string_split(text, chr(10))) as l from u),
n as (select distinct l from l where source = 'newspaper' and length(l) >= 20) select uid, round(sum(case when n.l is not null then length(l.l) else 0 end)::double / sum(length(l.l)), 4) as shared from l left join n using (l) where l.source = 'web' group by uid having sum(length(l.l)) > 0""")
def d24_also_in_newspaper(s, d):
    u = table(s, d, "build", "uid", "text", "source").groupBy("uid").agg(F.min("text").alias("text"), F.min("source").alias("source"))
    l = u.select("uid", "source", F.explode(F.split("text", "\n")).alias("l"))
    n = l.where((F.col("source") == "newspaper") & (F.length("l") >= 20)).select("l", F.lit(1).alias("hit")).distinct()
    w = l.where("source = 'web'").join(n, "l", "left").groupBy("uid").agg(F.sum(F.when(F.col("hit") == 1, F.length("l")).otherwise(0)).alias("a"), F.sum(F.length("l")).alias("b")).where("b > 0")
    return w.select("uid", F.round(F.col("a") / F.col("b"), 4).alias("shared"))


@query("select digest, arg_min(doc_id, (url, doc_id)) as doc_id, count(*) as n from (select doc_id, url, md5(text) as digest from documents where text is not null and url is not null) group by digest")
def d25_digest_dedup(s, d):
    x = table(s, d, "documents", "doc_id", "url", "text").where("text is not null and url is not null").select("doc_id", "url", F.md5("text").alias("digest"))
    return x.groupBy("digest").agg(F.min_by("doc_id", F.struct("url", "doc_id")).alias("doc_id"), F.count("*").alias("n"))


@query("select tokenizer_sha256, count(distinct id) as n_ids, min(id) as first_id from health_gates_and_support where id is not null group by tokenizer_sha256")
def d26_identical_encoders(s, d):
    return table(s, d, "health_gates_and_support", "id", "tokenizer_sha256").where("id is not null").groupBy("tokenizer_sha256").agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"))


_PAIRS = f"""t as {_GROUPED}, g as (select distinct grp, gram from ({_grams_sql('t', 'uid, grp')})), n as (select grp, count(*) as n from g group by grp), k as (select g.* from g join (select gram from g group by gram having count(*) between 2 and 10) using (gram)),
p as (select a.grp as a, b.grp as b, count(*) as shared from k a join k b on a.gram = b.gram and a.grp < b.grp group by 1, 2), e as (select a, b from p join n x on x.grp = a join n y on y.grp = b where shared >= 0.25 * least(x.n, y.n))"""


def _group_pairs(s, d):
    g = _grouped(s, d).select("grp", F.explode(F.array_distinct(T.gram_hashes(T.leak_words(F.col("text")), GRAM))).alias("gram"))
    g = cut(g.distinct())
    n = g.groupBy("grp").agg(F.count("*").alias("n"))
    k = g.join(g.groupBy("gram").agg(F.count("*").alias("c")).where("c between 2 and 10").select("gram"), "gram", "left_semi")
    p = k.withColumnRenamed("grp", "a").join(k.withColumnRenamed("grp", "b"), "gram").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return p.join(n.select(F.col("grp").alias("a"), F.col("n").alias("n1")), "a").join(n.select(F.col("grp").alias("b"), F.col("n").alias("n2")), "b"), n


@query(f"with {_PAIRS} select a, b, shared from p")
def j11_d28_group_overlap(s, d):
    return _group_pairs(s, d)[0].select("a", "b", "shared")


@query(f"""with recursive {_PAIRS}, both_ways as (select a, b from e union select b, a from e), reach as (select grp as node, grp as other from n union select r.node, w.b from reach r join both_ways w on r.other = w.a)
select node as grp, min(other) as component from reach group by node""")
def d27_group_merge(s, d):
    p, n = _group_pairs(s, d)
    e = p.where(F.col("shared") >= 0.25 * F.least("n1", "n2")).select("a", "b")
    return components(e, n.select(F.col("grp").alias("node"))).withColumnRenamed("node", "grp")


@query(f"""with g as ({_grams_sql('documents', 'doc_id')}), k as (select g.* from g join (select gram from g group by gram having count(*) between {DF_MIN} and {DF_MAX}) using (gram))
select a.doc_id as a, b.doc_id as b, count(*) as shared from k a join k b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2 having count(*) >= {MIN_GRAMS}""")
def j06_gram_pairs(s, d):
    g = cut(grams(_docs(s, d), "doc_id"))
    k = g.join(g.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df").between(DF_MIN, DF_MAX)).select("gram"), "gram", "left_semi")
    p = k.withColumnRenamed("doc_id", "a").join(k.withColumnRenamed("doc_id", "b"), "gram").where("a < b")
    return p.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= MIN_GRAMS)


@query("""with f as (select distinct lower(site) as f, l from (select site, unnest(string_split(text, chr(10))) as l from build where site is not null) where length(l) >= 12),
k as (select f.* from f join (select l from f group by l having count(*) between 2 and 40) using (l)) select a.f as a, b.f as b, sum(length(a.l)) as shared_chars from k a join k b on a.l = b.l and a.f < b.f group by 1, 2""")
def j07_line_pairs(s, d):
    f = table(s, d, "build", "site", "text").where("site is not null").select(F.lower("site").alias("f"), F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 12).distinct()
    k = f.join(f.groupBy("l").agg(F.count("*").alias("c")).where("c between 2 and 40").select("l"), "l", "left_semi")
    p = k.withColumnRenamed("f", "a").join(k.withColumnRenamed("f", "b"), "l").where("a < b")
    return p.groupBy("a", "b").agg(F.sum(F.length("l")).alias("shared_chars"))
