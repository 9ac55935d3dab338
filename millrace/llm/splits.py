"""Splits that keep related records together: components of keys, and a min-cost flow over bundles of components.

A record's key is its edition (issue:slug:number), its folder (dir:folder) or its tokenizer run (run:id). Keys meet in
attributes: the day of an edition within one slug, a book's farma number, a run's arm number. Connected components of
this two-sided graph are found by spreading the least label, with pointer jumping. A record without a key is a component
of its own. Components of equal size and label profile form one bundle; a min-cost flow sends the bundles' records to the splits with a cost per record of deviation
from the quotas, overall and per profile; whole components are rounded from the flow and members drawn by hash.

Null paths and sources give no key, null uids and ids no row; an issue without a digit counts as no issue; repeated rows
count once per uid (or run id), under their least key; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import HUB, split_hubs
from ..operators.graph import components as graph_components
from ..session import cut
from .common import ascii_digits, bounded, clean_path, folder_of, ranked

QUOTAS = {"train": 0.90, "validation": 0.05, "test": 0.05}
#: The labels of which a component's profile has the shares.
LABELS = ("newspaper", "book", "web", "run", "other")
#: What the key of a record without a key begins with.
ALONE = "uid:"
#: The pairs of a component are made in parts of about so many keys.
PAIRED = 1000


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.when((year != "") & month.cast("int").between(1, 12) & day.cast("int").between(1, 31), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def folder_day(folder: Column) -> Column:
    """The day a folder names as year/month/day or day/month/year, with any of / - . _ or a space between, else null."""
    f = ascii_digits(folder)
    ymd, dmy = r"(?<!\d)((?:19|20)\d\d)[-./_ ](\d{1,2})[-./_ ](\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})[-./_ ](\d{1,2})[-./_ ]((?:19|20)\d\d)(?!\d)"
    part = lambda p, i: F.regexp_extract(f, p, i)
    return F.coalesce(_day(part(ymd, 1), part(ymd, 2), part(ymd, 3)), _day(part(dmy, 3), part(dmy, 2), part(dmy, 1)))


def record_keys(build: DataFrame) -> DataFrame:
    """(uid, key, label, attr): each record's key (ALONE and its uid if it has none) and one attribute it carries (null if
    none)."""
    folder = folder_of(F.col("source_path"))
    slug = F.regexp_extract(clean_path(F.col("source_path")), r"^[^/]+/([^/]+)/", 1)
    number = F.regexp_replace(F.regexp_extract(ascii_digits(F.col("issue")), r"(\d+)", 1), r"^0+(?=\d)", "")
    news = F.col("source") == "newspaper"
    has_issue = news & (F.coalesce(number, F.lit("")) != "")
    key = F.when(has_issue, F.concat(F.lit("issue:"), slug, F.lit(":"), number)).when(news | (F.col("source") == "book"), F.concat(F.lit("dir:"), folder))
    dated = F.when(F.col("date_precision") == "day", _day(*(F.regexp_extract(F.col("date"), r"^(\d{4})-(\d\d)-(\d\d)", i) for i in (1, 2, 3))))
    farma = F.regexp_replace(F.regexp_extract(ascii_digits(folder), r"farma\D*?(\d+)", 1), r"^0+(?=\d)", "")
    day = lambda d: F.when(news & d.isNotNull(), F.concat(F.lit("day:"), slug, F.lit(":"), d))
    book = F.when((F.col("source") == "book") & (farma != ""), F.concat(F.lit("farma:"), farma))
    attrs = F.array_compact(F.array(day(dated), day(folder_day(folder)), book))
    label = F.when(F.col("source").isin(*LABELS), F.col("source")).otherwise("other")
    rows = build.where("uid is not null").select("uid", F.coalesce(key, F.concat(F.lit(ALONE), "uid")).alias("key"), label.alias("label"), F.when(key.isNotNull(), attrs).alias("attrs"))
    return rows.select("uid", "key", "label", F.explode_outer("attrs").alias("attr"))


def run_keys(gates: DataFrame) -> DataFrame:
    """(uid, key, label, attr) of tokenizer runs; uid is the id as typed."""
    arm = F.regexp_replace(F.regexp_extract(ascii_digits(F.col("id")), r"(?<![A-Za-z0-9])[Aa](\d+)(?![A-Za-z0-9])", 1), r"^0+(?=\d)", "")
    return gates.where("id is not null").select(F.col("id").alias("uid"), F.concat(F.lit("run:"), "id").alias("key"), F.lit("run").alias("label"), F.when(arm != "", F.concat(F.lit("arm:"), arm)).alias("attr"))


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(key, component): the least key of each key's connected component. edges: (key, attr), attr may be null. An
    attribute of very many keys is dealt into parts (operators.graph)."""
    # The mark sorts after every key, so the least label of a component is always a key's.
    links = split_hubs(edges.select("key", F.concat(F.lit("~"), "attr").alias("attr")), "attr", "key", hub)
    found = graph_components(links.select(F.col("key").alias("a"), F.col("attr").alias("b")), edges.select(F.col("key").alias("node")))
    return found.withColumnRenamed("node", "key")


def keyed(build: DataFrame, gates: DataFrame) -> DataFrame:
    return cut(record_keys(build).unionByName(run_keys(gates)).distinct())


def found(build: DataFrame, gates: DataFrame, part: int = PAIRED) -> DataFrame:
    """(key_a, key_b): all pairs of different keys that assign() holds together in one split, key_a < key_b.

    The keys of a large component are dealt into parts of about `part`, each of which meets the whole component, so no
    task gets all its pairs."""
    held = cut(assign(build, gates).where(~F.col("key").startswith(ALONE)).select("component", "split", "key").distinct())
    many = cut(held.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    c = held.join(bounded(many), "component")
    a = c.select("component", "split", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("key_a"))
    b = c.select("component", "split", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("key_b"))
    return a.join(b, ["component", "split", "part"]).where("key_a < key_b").select("key_a", "key_b")


class Flow:
    """Min-cost flow by successive shortest paths (Bellman-Ford with a queue); capacities and costs are numbers."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[float] = []
        self.cost: list[float] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cap: float, cost: float) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.cap += [cap, 0.0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            dist, via, queue, queued = {s: 0.0}, {}, [s], {s}
            for u in queue:
                queued.discard(u)
                for e in self.out[u]:
                    if self.cap[e] > 1e-9 and dist[u] + self.cost[e] < dist.get(self.to[e], np.inf) - 1e-12:
                        dist[self.to[e]], via[self.to[e]] = dist[u] + self.cost[e], e
                        if self.to[e] not in queued:
                            queue.append(self.to[e])
                            queued.add(self.to[e])
            if t not in dist:
                return
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def allocate(bundles: list[tuple[str, int, int]], quotas: dict[str, float] = QUOTAS) -> list[list[int]]:
    """How many components of each bundle (profile, size, count) go to each split.

    Costs: one per record beyond a split's quota, a quarter per record beyond a profile's share of it, and for sending
    a component larger than the quota to a split two per record, so that large ones stay where they fit. Bundles of one
    profile that fit every quota are alike to the flow and enter it as one; what flows is then dealt to them whole,
    largest components first.
    """
    names = list(quotas)
    total = sum(s * c for _, s, c in bundles)
    profiles = sorted({p for p, _, _ in bundles})
    of: dict[str, int] = defaultdict(int)
    for p, s, c in bundles:
        of[p] += s * c
    f, node = Flow(), iter(range(10**9))
    s, t = next(node), next(node)
    split = [next(node) for _ in names]
    part = {(p, k): next(node) for p in profiles for k in range(len(names))}
    big = float(total) + 1
    for k, name in enumerate(names):
        f.arc(split[k], t, quotas[name] * total, 0)
        f.arc(split[k], t, big, 1)
        for p in profiles:
            f.arc(part[p, k], split[k], quotas[name] * of[p], 0)
            f.arc(part[p, k], split[k], big, 0.25)
    # Supplies: which splits a component of the bundle is too large for decides what it costs.
    supply: dict[tuple[str, tuple[bool, ...]], list[int]] = defaultdict(list)
    for i, (p, size, _) in enumerate(bundles):
        supply[p, tuple(size > quotas[n] * total for n in names)].append(i)
    arcs = {}
    for (p, large), own in sorted(supply.items()):
        b = next(node)
        f.arc(s, b, float(sum(bundles[i][1] * bundles[i][2] for i in own)), 0)
        arcs[p, large] = [f.arc(b, part[p, k], big, 2.0 if large[k] else 0.0) for k in range(len(names))]
    f.run(s, t)
    left = [quotas[n] * total for n in names]
    takes: list[list[int]] = [[] for _ in bundles]
    for at, own in sorted(supply.items(), key=lambda x: (-max(bundles[i][1] for i in x[1]), x[0])):
        flow = [f.cap[e ^ 1] for e in arcs[at]]
        for i in sorted(own, key=lambda i: (-bundles[i][1], i)):
            _, size, count = bundles[i]
            supplied = max(1e-9, sum(x for x in flow if x > 0))
            whole = [int(min(count * max(0.0, x) / supplied, max(0.0, x) / size) + 1e-9) for x in flow]
            for _ in range(count - sum(whole)):
                k = max(range(len(names)), key=lambda k: (flow[k] - whole[k] * size, left[k]))
                whole[k] += 1
            for k in range(len(names)):
                flow[k] -= whole[k] * size
                left[k] -= whole[k] * size
            takes[i] = whole
    # What rounding left over: smaller components move from splits beyond their quota to those below, largest first.
    order = sorted(range(len(bundles)), key=lambda i: -bundles[i][1])
    for k in sorted(range(len(names)), key=lambda k: -left[k]):
        for i in order:
            size = bundles[i][1]
            for j in range(len(names)):
                n = int(min(takes[i][j], left[k] // size, -left[j] // size + (left[j] < 0 and -left[j] % size > 0)))
                if j != k and n > 0 and left[k] > 0 > left[j]:
                    takes[i][j] -= n
                    takes[i][k] += n
                    left[k] -= n * size
                    left[j] += n * size
    return takes


def assign(build: DataFrame, gates: DataFrame, quotas: dict[str, float] = QUOTAS) -> DataFrame:
    """(uid, key, component, split): one row per record with a uid and per run with an id. Related records share a
    component and so a split; a record without a key is a component of its own."""
    rows = keyed(build, gates)
    comp = components(rows.select("key", "attr"))
    one = rows.groupBy("uid", (F.col("label") == "run").alias("run")).agg(F.min(F.struct("key", "label")).alias("r")).select("uid", "r.key", "r.label")
    one = cut(one.join(comp, "key"))
    # A component's profile: the share of its records with each label, in quarters.
    share = lambda l: F.round(4 * F.count_if(F.col("label") == l) / F.count("*")).cast("int").cast("string")
    sizes = cut(one.groupBy("component").agg(F.count("*").alias("size"), F.concat_ws(".", *(share(l) for l in LABELS)).alias("profile")))
    bundles = [(r["profile"], r["size"], r["n"]) for r in sizes.groupBy("profile", "size").agg(F.count("*").alias("n")).orderBy("profile", "size").collect()]
    takes = allocate(bundles, quotas) if bundles else []
    spans = []
    for (p, size, _), counts in zip(bundles, takes, strict=True):
        lo = 0
        for name, n in zip(quotas, counts, strict=True):
            if n:
                spans.append((p, size, lo, lo + n, name))
                lo += n
    table = build.sparkSession.createDataFrame(spans, "profile string, size bigint, lo bigint, hi bigint, split string")
    at = ranked(sizes, ["profile", "size"], "component")
    chosen = at.join(bounded(table), ["profile", "size"]).where("rank >= lo and rank < hi").select("component", "split")
    return one.join(chosen, "component").select("uid", "key", "component", "split")


def report(build: DataFrame, gates: DataFrame, quotas: dict[str, float] = QUOTAS) -> DataFrame:
    """Per split its records and components, the quota, and by how many records and which share of all it deviates."""
    rows = cut(assign(build, gates, quotas).groupBy("split").agg(F.count("*").alias("n_records"), F.count_distinct("component").alias("n_components")))
    want = build.sparkSession.createDataFrame(list(quotas.items()), "split string, quota double")
    total = F.sum(F.coalesce("n_records", F.lit(0))).over(Window.partitionBy())
    out = want.join(rows, "split", "left").withColumn("total", total).where("total > 0")
    n = F.coalesce("n_records", F.lit(0))
    return out.select("split", n.alias("n_records"), F.coalesce("n_components", F.lit(0)).alias("n_components"), "quota", F.round(n - F.col("quota") * F.col("total"), 2).alias("deviation"), F.round(n / F.col("total") - F.col("quota"), 6).alias("deviation_share"))


def checks(build: DataFrame, gates: DataFrame) -> DataFrame:
    """What must hold of an assignment: every record once, no key and no attribute in two splits."""
    rows = cut(assign(build, gates))
    attrs = keyed(build, gates).where("attr is not null").select("key", "attr").join(rows.select("key", "split").distinct(), "key")
    torn = attrs.groupBy("attr").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("torn_attributes"))
    per = rows.groupBy("key").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("torn_keys"))
    return rows.agg(F.count("*").alias("n_records"), F.count_distinct("component").alias("n_components")).crossJoin(per).crossJoin(torn)
