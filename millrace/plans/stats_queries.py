"""Windows, ordered analytics, statistics and models."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..io import table
from ..operators import folds
from ..session import cut
from .catalog import query

_TOK = "(select doc_id, unnest(range(len(w))) as pos, unnest(w) as w from (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') as w from documents where text is not null))"


def _tok(s, d):
    t = table(s, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "w"))


def _neighbours(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return _tok(s, d).withColumn("prev", F.coalesce(F.lag("w").over(w), F.lit("START"))).withColumn("next", F.coalesce(F.lead("w").over(w), F.lit("END")))


@query(f"with n as (select w, coalesce(lag(w) over (partition by doc_id order by pos), 'START') as prev from {_TOK}) select prev, w as word, count(*) as n from n group by prev, w having count(*) >= 10")
def w01_neighbours(s, d):
    return _neighbours(s, d).groupBy("prev", F.col("w").alias("word")).agg(F.count("*").alias("n")).where("n >= 10")


@query(f"with n as (select w, coalesce(lead(w) over (partition by doc_id order by pos), 'END') as next from {_TOK}), c as (select w, next, count(*) as n from n group by w, next), r as (select *, row_number() over (partition by w order by n desc, next) as k, sum(n) over (partition by w) as t from c) select w as word, next, n, k from r where k <= 3 and t >= 50")
def w02_top_neighbours(s, d):
    c = _neighbours(s, d).groupBy("w", "next").agg(F.count("*").alias("n"))
    t = c.groupBy("w").agg(F.sum("n").alias("t")).where("t >= 50").select("w")
    k = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("n"), "next"))
    return c.join(t, "w").withColumn("k", k).where("k <= 3").select(F.col("w").alias("word"), "next", "n", "k")


@query(f"with k as (select doc_id, pos, w, string_agg(w, ' ') over (partition by doc_id order by pos rows between 6 preceding and 1 preceding) as l, string_agg(w, ' ') over (partition by doc_id order by pos rows between 1 following and 6 following) as r from {_TOK}) select doc_id, pos, coalesce(l, '') as left_context, coalesce(r, '') as right_context from k where w = 'شہر'")
def w03_keyword_in_context(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    k = _tok(s, d).withColumn("l", F.collect_list("w").over(w.rowsBetween(-6, -1))).withColumn("r", F.collect_list("w").over(w.rowsBetween(1, 6)))
    return k.where("w = 'شہر'").select("doc_id", "pos", F.array_join("l", " ").alias("left_context"), F.array_join("r", " ").alias("right_context"))


@query("with l as (select uid, unnest(range(len(x))) as pos, unnest(x) as l from (select uid, string_split(min(text), chr(10)) as x from build where text is not null group by uid)) select uid, l as line, min(pos) as first_pos, count(*) as n from l group by uid, l having count(*) > 1")
def w04_first_occurrence(s, d):
    b = table(s, d, "build", "uid", "text").where("text is not null").groupBy("uid").agg(F.min("text").alias("text"))
    return b.select("uid", F.posexplode(F.split("text", "\n")).alias("pos", "line")).groupBy("uid", "line").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1")


@query("with l as (select doc_id, length(text) as n from documents where lang = 'en' and text is not null), c as (select doc_id, n, sum(n) over (order by doc_id) as cum from l) select doc_id, cum from c where cum <= 20000")
def w08_cumulative_budget(s, d):
    """Items in order until the budget is first passed. Only items of the smallest keys can be in it, so they are found
    from counts per key range, and the running sum covers these alone."""
    l = table(s, d, "documents", "doc_id", "text", "lang").where("lang = 'en' and text is not null").select("doc_id", F.length("text").alias("n"))
    blocks = l.groupBy(F.floor(F.col("doc_id") / 1000).alias("b")).agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).where("before <= 20000").select("b", "before")
    k = l.withColumn("b", F.floor(F.col("doc_id") / 1000)).join(F.broadcast(blocks), "b")
    cum = F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("doc_id"))
    return k.withColumn("cum", cum).where("cum <= 20000").select("doc_id", "cum")


@query("""with recursive l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) as n from documents where text is not null and doc_id is not null),
r as (select doc_id, 0 as i, 0::bigint as used, false as taken from l union all select r.doc_id, i + 1, used + case when used + n[i + 1] <= 500 then n[i + 1] else 0 end, used + n[i + 1] <= 500 from r join l using (doc_id) where i < len(n))
select r.doc_id, i - 1 as line_no, n[i] as n_chars from r join l using (doc_id) where taken""")
def w09_budget_with_skip(s, d):
    """Per document, the lines taken in order when each that fits the rest of a budget of 500 characters is."""
    x = table(s, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    taken = folds.budget_with_skip(F.transform("l", lambda r: F.length(r).cast("bigint")), 500)
    e = x.select("doc_id", F.posexplode(F.arrays_zip(F.col("l"), taken.alias("t"))).alias("line_no", "z"))
    return e.where("z.t").select("doc_id", "line_no", F.length("z.l").alias("n_chars"))


@query("select doc_id, s as start_at, least(s + 512, n) as end_at, case when s = 0 then least(512, n) else least(s + 512, n) - least(s + 256, n) end as scored from (select doc_id, n, unnest(range(0, greatest(n - 256, 1), 256)) as s from (select doc_id, strlen(text) as n from documents where text <> ''))")
def w10_evaluation_windows(s, d):
    """Windows of 512 bytes at a stride of 256: after the first, each scores its second half, so every byte once."""
    x = table(s, d, "documents", "doc_id", "text").where("text <> ''").select("doc_id", F.octet_length("text").alias("n"))
    w = x.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 257, F.lit(0)), F.lit(256))).alias("s"))
    end = F.least(F.col("s") + 512, F.col("n"))
    return w.select("doc_id", F.col("s").alias("start_at"), end.alias("end_at"), F.when(F.col("s") == 0, F.least(F.lit(512), F.col("n"))).otherwise(end - F.least(F.col("s") + 256, F.col("n"))).alias("scored"))


@query("""with recursive l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))) as n from documents where text <> '' and doc_id is not null),
r as (select doc_id, 0 as i, 0::bigint as held, 0 as unit from l union all select r.doc_id, i + 1, case when held >= 50 then 0 else held end + n[i + 1], unit + (held >= 50)::int from r join l using (doc_id) where i < len(n)),
e as (select doc_id, unit, max(held) as n_words from r where i > 0 group by 1, 2), z as (select *, max(unit) over (partition by doc_id) as last from e),
k as (select doc_id, case when unit = last and unit > 0 and n_words < 50 then unit - 1 else unit end as unit, n_words, last from z)
select doc_id, unit, sum(n_words)::bigint as n_words from k group by 1, 2 having max(last) > 0 or sum(n_words) > 0""")
def w11_w13_pack_units(s, d):
    """Paragraphs packed into units of at least 50 words within each document."""
    x = table(s, d, "documents", "doc_id", "text").where("text is not null and text <> ''")
    sizes = F.transform(F.split("text", "\n"), lambda l: F.size(F.filter(F.split(l, r"\s+"), lambda w: w != "")).cast("bigint"))
    u = x.select("doc_id", folds.pack_units(sizes, 50).alias("u"))
    return u.select("doc_id", F.posexplode("u").alias("unit", "n_words"))


@query()
def w12_u06_segment_articles(s, d):
    return folds.segment(table(s, d, "build", "id", "text").where("id is not null"), "id", "text")


@query("select split, uid from (select split, uid, row_number() over (partition by split order by md5(uid || ':7'), uid) as rn from (select distinct split, uid from split_manifest)) where rn <= 5")
def w15_seeded_sample(s, d):
    """Five records per split by hash: each task keeps its own least ones before the window sees them."""
    m = table(s, d, "split_manifest", "split", "uid").distinct().withColumn("h", F.md5(F.concat("uid", F.lit(":7"))))
    part = F.pmod(F.xxhash64("uid"), F.lit(64))
    few = m.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("split", "p").orderBy("h", "uid"))).where("r <= 5")
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy("h", "uid"))).where("rn <= 5").select("split", "uid")


@query("select right(sha1(uid), 1) = '0' as held_out, count(*) as n from (select distinct uid from build) group by 1")
def w17_hash_holdout(s, d):
    return table(s, d, "build", "uid").distinct().groupBy((F.substring(F.sha1("uid"), -1, 1) == "0").alias("held_out")).agg(F.count("*").alias("n"))


@query(f"with n as (select w, coalesce(lag(w) over (partition by doc_id order by pos), '') as p from {_TOK}) select w as word, count(*) as n, round(avg((p = '')::int), 6) as first_share, round(avg((p = w)::int), 6) as repeat_share from n group by w having count(*) >= 100")
def w18_neighbour_shares(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    n = _tok(s, d).withColumn("p", F.coalesce(F.lag("w").over(w), F.lit("")))
    return n.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") == "").cast("int")), 6).alias("first_share"), F.round(F.avg((F.col("p") == F.col("w")).cast("int")), 6).alias("repeat_share")).where("n >= 100")


# --- statistics over the bits tensor -------------------------------------------------------------------------------

REPS = 40
_DRAW = "(('0x' || substr(md5(r || ':' || source || ':' || j), 1, 8))::bigint % k)"
_BITS = "(select distinct b.candidate, b.seed, b.uid, b.bits, b.bytes, m.source, m.group_key from bits_records b join (select distinct uid, source, group_key from split_manifest) m using (uid) where b.bits is not null)"
_BOOT = f"""x as {_BITS}, c as (select candidate, source, group_key, sum(bits) as bits, sum(bytes) as bytes from x group by all),
k as (select source, group_key, row_number() over (partition by source order by group_key) - 1 as i, count(*) over (partition by source) as k from (select distinct source, group_key from x)),
draws as (select r, source, {_DRAW} as i from (select distinct source, k from k), range({REPS}) t(r), range(1000) u(j) where j < k),
w as (select r, source, i, count(*) as w from draws group by all),
reps as (select r, candidate, sum(w * bits) / sum(w * bytes) as bpb from w join k using (source, i) join c using (source, group_key) group by r, candidate)"""


def _bits(s, d):
    b = table(s, d, "bits_records").where("bits is not null")
    m = table(s, d, "split_manifest", "uid", "source", "group_key").distinct()
    return b.join(m, "uid").distinct()


def _reps(s, d):
    """(r, candidate, bpb): clusters resampled within their source; weights depend on a hash of (rep, source, draw)."""
    x = _bits(s, d)
    c = x.groupBy("candidate", "source", "group_key").agg(F.sum("bits").alias("bits"), F.sum("bytes").alias("bytes"))
    k = x.select("source", "group_key").distinct()
    k = k.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("group_key")) - 1)
    n = k.groupBy("source").agg(F.count("*").alias("k"))
    draws = n.select("source", "k", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))).alias("r")).select("source", "k", "r", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("j"))
    i = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "r", "source", "j")), 1, 8), 16, 10).cast("bigint"), F.col("k"))
    w = draws.groupBy("r", "source", i.alias("i")).agg(F.count("*").alias("w"))
    return w.join(k, ["source", "i"]).join(c, ["source", "group_key"]).groupBy("r", "candidate").agg((F.sum(F.col("w") * F.col("bits")) / F.sum(F.col("w") * F.col("bytes"))).alias("bpb"))


@query(f"with {_BOOT} select candidate, count(*) as n_reps, round(avg(bpb), 6) as mean_bpb, round(quantile_cont(bpb, 0.025), 6) as lo, round(quantile_cont(bpb, 0.975), 6) as hi from reps group by candidate")
def l04_cluster_bootstrap(s, d):
    return _reps(s, d).groupBy("candidate").agg(F.count("*").alias("n_reps"), F.round(F.avg("bpb"), 6).alias("mean_bpb"), F.round(F.percentile("bpb", 0.025), 6).alias("lo"), F.round(F.percentile("bpb", 0.975), 6).alias("hi"))


_CMP = f"""with {_BOOT}, base as (select min(candidate) as b from c), d as (select a.r, a.candidate, a.bpb - b.bpb as d from reps a join reps b on a.r = b.r and b.candidate = (select b from base) where a.candidate <> b.candidate),
p as (select candidate, count(*) as n, round(avg(d), 6) as delta, least(1.0, 2.0 * least(count(*) filter (where d <= 0), count(*) filter (where d >= 0)) / count(*)) as p, round(quantile_cont(d, 0.05), 6) as lo90, round(quantile_cont(d, 0.95), 6) as hi90 from d group by candidate)"""


def _compared(r):
    base = r.agg(F.min("candidate").alias("b"))
    b = r.join(F.broadcast(base), r.candidate == base.b).select("r", F.col("bpb").alias("bpb0"), "b")
    x = r.join(b, "r").where("candidate <> b").withColumn("d", F.col("bpb") - F.col("bpb0"))
    p = F.least(F.lit(1.0), 2.0 * F.least(F.count_if(F.col("d") <= 0), F.count_if(F.col("d") >= 0)) / F.count("*"))
    return x.groupBy("candidate").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("delta"), p.alias("p"), F.round(F.percentile("d", 0.05), 6).alias("lo90"), F.round(F.percentile("d", 0.95), 6).alias("hi90"))


def _verdict(o):
    return o.select("candidate", "delta", F.round("p", 6).alias("p"), "lo90", "hi90", ((F.col("lo90") > -0.05) & (F.col("hi90") < 0.05)).alias("equivalent"))


def _holm(o):
    w = Window.orderBy("p", "candidate")
    o = o.withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy()))
    adj = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("i")) * F.col("p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return o.select("candidate", F.round(adj, 6).alias("adjusted"))


_RANKED = "(select id, min(dev_fertility) as a, min(dev_bytes_per_token) as b from health_gates_and_support where id is not null and dev_fertility is not null and dev_bytes_per_token is not null group by id)"


def _ranked(s, d):
    return table(s, d, "health_gates_and_support", "id", "dev_fertility", "dev_bytes_per_token").dropna().groupBy("id").agg(F.min("dev_fertility").alias("a"), F.min("dev_bytes_per_token").alias("b"))


@query(f"{_CMP} select candidate, delta, round(p, 6) as p, lo90, hi90, (lo90 > -0.05 and hi90 < 0.05) as equivalent from p")
def l05_intervals_and_equivalence(s, d):
    return _verdict(_compared(_reps(s, d)))


@query(f"{_CMP}, o as (select candidate, p, row_number() over (order by p, candidate) - 1 as i, count(*) over () as m from p) select candidate, round(max(least(1.0, (m - i) * p)) over (order by p, candidate rows unbounded preceding), 6) as adjusted from o")
def l06_w07_holm(s, d):
    """Step-down adjustment; one row per candidate, a table as small as the list of candidates."""
    return _holm(_compared(_reps(s, d)))


#: Replicates of the hierarchical form, and cells of weights held at once.
HIERARCHICAL_REPS, CELLS = 10_000, 2_000_000


def hierarchical_reps(x, n_reps=HIERARCHICAL_REPS):
    """(r, candidate, bpb): clusters resampled within their source, the same ones for all candidates, and seeds within
    the candidate. x is _bits. Each candidate's clusters go to one task, which draws weights in blocks."""
    c = x.groupBy("candidate", "seed", "source", "group_key").agg(F.sum("bits").cast("double").alias("bits"), F.sum("bytes").cast("double").alias("bytes"))
    k = x.select("source", "group_key").distinct()
    k = k.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("group_key")) - 1)
    k = k.join(k.groupBy("source").agg(F.count("*").alias("k")), "source").withColumn("key", F.crc32(F.col("source").cast("binary")))

    def draw(t: pa.Table) -> pa.Table:
        seeds, at = np.unique(t["seed"].to_numpy(), return_inverse=True)
        source, i, size, bits, bytes_ = (t[z].to_numpy() for z in ("key", "i", "k", "bits", "bytes"))
        total = np.zeros((2, n_reps, len(seeds)))
        for key in np.unique(source):
            own = source == key
            n = int(size[own][0])
            sums = np.zeros((2, n, len(seeds)))
            np.add.at(sums[0], (i[own], at[own]), bits[own])
            np.add.at(sums[1], (i[own], at[own]), bytes_[own])
            rng, step = np.random.default_rng([7, int(key)]), max(1, CELLS // n)
            for lo in range(0, n_reps, step):
                w = rng.multinomial(n, np.full(n, 1 / n), min(step, n_reps - lo)).astype(float)
                total[:, lo : lo + step] += w @ sums
        name = t["candidate"][0].as_py()
        m = np.random.default_rng([11, zlib.crc32(name.encode())]).multinomial(len(seeds), np.full(len(seeds), 1 / len(seeds)), n_reps)
        num, den = (total * m).sum(2)
        some = den > 0
        return pa.table({"r": pa.array(np.flatnonzero(some).astype(np.int32)), "candidate": pa.array([name] * int(some.sum()), pa.string()), "bpb": num[some] / den[some]})

    rows = c.where("candidate is not null and seed is not null").join(k, ["source", "group_key"]).select("candidate", "seed", "key", "i", "k", "bits", "bytes")
    return cut(rows.groupBy("candidate").applyInArrow(draw, "r int, candidate string, bpb double"))


def _limits(r):
    return r.groupBy("candidate").agg(F.count("*").alias("n_reps"), F.round(F.avg("bpb"), 6).alias("mean_bpb"), F.round(F.percentile("bpb", 0.025), 6).alias("lo"), F.round(F.percentile("bpb", 0.975), 6).alias("hi"))


@query()
def l04_hierarchical_bootstrap(s, d):
    return _limits(hierarchical_reps(_bits(s, d)))


@query()
def l05_hierarchical_intervals(s, d):
    return _verdict(_compared(hierarchical_reps(_bits(s, d))))


@query()
def l06_hierarchical_holm(s, d):
    return _holm(_compared(hierarchical_reps(_bits(s, d))))


@query(f"with h as (select * from {_RANKED}), p as (select sign(x.a - y.a) * sign(x.b - y.b) as s, x.a = y.a as ta, x.b = y.b as tb from h x join h y on x.id < y.id) select count(*) as n_pairs, round(sum(s) / sqrt((count(*) - sum(ta::int))::double * (count(*) - sum(tb::int))), 6) as tau_b from p")
def l07_kendall(s, d):
    """Over candidates, a stated small set: pairs are blocked by an inequality join on the id."""
    h = _ranked(s, d)
    y = h.select(F.col("id").alias("id2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    p = h.join(F.broadcast(y), F.col("id") < F.col("id2"))
    s_ = F.signum(F.col("a") - F.col("a2")) * F.signum(F.col("b") - F.col("b2"))
    n = F.count("*")
    return p.agg(n.alias("n_pairs"), F.round(F.sum(s_) / F.sqrt((n - F.count_if(F.col("a") == F.col("a2"))) * (n - F.count_if(F.col("b") == F.col("b2"))).cast("double")), 6).alias("tau_b"))


@query(f"with r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from {_RANKED}) select round(corr(ra, rb), 6) as rho from r")
def l07_spearman(s, d):
    h = _ranked(s, d)

    def ranks(c):
        v = h.groupBy(c).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return v.select(c, (before + 1 + (F.col("n") - 1) / 2).alias(f"r{c}"))

    return h.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


@query(f"with x as {_BITS}, b as (select candidate, seed, sum(bits) / sum(bytes) as bpb from x group by 1, 2) select candidate, count(*) as n_seeds, ceil(2 * pow((1.96 + 0.84) * stddev_samp(bpb) / (0.01 * avg(bpb)), 2))::bigint as seeds_needed from b group by candidate having count(*) > 1")
def l08_seeds_needed(s, d):
    b = _bits(s, d).groupBy("candidate", "seed").agg((F.sum("bits") / F.sum("bytes")).alias("bpb"))
    g = b.groupBy("candidate").agg(F.count("*").alias("n_seeds"), F.stddev_samp("bpb").alias("sd"), F.avg("bpb").alias("m")).where("n_seeds > 1")
    return g.select("candidate", "n_seeds", F.ceil(2 * F.pow((1.96 + 0.84) * F.col("sd") / (0.01 * F.col("m")), F.lit(2.0))).cast("bigint").alias("seeds_needed"))


@query("select label, count(*) as n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 4) as mean_norm, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 4) as largest_norm from embeddings group by label")
def l10_embedding_norms(s, d):
    e = table(s, d, "embeddings", "label", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"), F.round(F.max(norm), 4).alias("largest_norm"))


@query("select label, i as dim, round(avg(x), 4) as mean from (select label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings) group by label, i")
def l10_embedding_means(s, d):
    e = table(s, d, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


@query("select role, arg_min(id, (f, id)) as best, round(min(f), 6) as fertility from (select role, id, round(dev_fertility, 9) as f from health_gates_and_support where dev_fertility is not null and id is not null) group by role")
def l13_best_run(s, d):
    h = table(s, d, "health_gates_and_support", "role", "id", "dev_fertility").where("dev_fertility is not null and id is not null").withColumn("f", F.round("dev_fertility", 9))
    return h.groupBy("role").agg(F.min_by("id", F.struct("f", "id")).alias("best"), F.round(F.min("f"), 6).alias("fertility"))


@query(f"with x as {_BITS}, s as (select candidate, seed, sum(bits) / sum(bytes) as v from x group by 1, 2), c as (select candidate, group_key, sum(bits) / sum(bytes) as v from x group by 1, 2) select candidate, round(a, 6) as seed_sd, round(b, 6) as cluster_sd from (select candidate, stddev_samp(v) as a from s group by candidate) join (select candidate, stddev_samp(v) as b from c group by candidate) using (candidate)")
def l14_variance_decomposition(s, d):
    x = _bits(s, d)
    sd = lambda by, name: x.groupBy("candidate", by).agg((F.sum("bits") / F.sum("bytes")).alias("v")).groupBy("candidate").agg(F.stddev_samp("v").alias(name))
    return sd("seed", "a").join(sd("group_key", "b"), "candidate").select("candidate", F.round("a", 6).alias("seed_sd"), F.round("b", 6).alias("cluster_sd"))


@query()
def l01_l02_language_classifier(s, d):
    """Hashed character n-grams and word counts, inverse document frequency and multinomial logistic regression, trained
    on some sources and tested on the others; per language the tested and the right ones."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    x = table(s, d, "documents", "doc_id", "text", "lang", "source").where("text is not null and text <> '' and lang is not null")
    grams = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    x = x.select("lang", "source", F.concat(grams, F.transform(grams, lambda w: F.concat(F.lit("s:"), F.right(w, F.lit(2))))).alias("f"))
    x = StringIndexer(inputCol="lang", outputCol="label").fit(x).transform(x)
    x = HashingTF(inputCol="f", outputCol="tf", numFeatures=1 << 12).transform(x)
    train, test = (x.where(F.pmod(F.xxhash64("source"), F.lit(4)) == 0), x.where(F.pmod(F.xxhash64("source"), F.lit(4)) != 0))
    train, test = test, train
    idf = IDF(inputCol="tf", outputCol="features").fit(train)
    n = train.groupBy("label").agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"), F.count("*").alias("k"))
    weights = n.crossJoin(F.broadcast(total)).select("label", (F.col("t") / (F.col("k") * F.col("c"))).alias("w"))
    model = LogisticRegression(maxIter=15, regParam=0.01, weightCol="w").fit(idf.transform(train).join(F.broadcast(weights), "label"))
    out = model.transform(idf.transform(test))
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("n_right"))


@query("select doc_id from documents where text is not null and len(list_filter(regexp_extract_all(text, '[\\p{L}]+'), lambda w: w in ('دا', 'دی', 'دے', 'نوں', 'اچ'))) >= 5")
def l03_prefiltered_scoring(s, d):
    x = table(s, d, "documents", "doc_id", "text").where("text is not null")
    hits = F.size(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: w.isin("دا", "دی", "دے", "نوں", "اچ")))
    return x.where(hits >= 5).select("doc_id")
