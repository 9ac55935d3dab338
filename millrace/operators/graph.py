"""Connected components of a key-value graph by least-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A hub of more neighbours than this is dealt into parts of about so many.
HUB = 10_000


def split_hubs(edges: DataFrame, hub: str, other: str, most: int = HUB) -> DataFrame:
    """(other, hub) with every hub (a string) of more than most neighbours in parts, each linked to the hub itself.

    The parts keep what is connected connected, and no join key has more than about most rows. A part's name is the
    hub's with its number behind it, so it sorts after the hub. Null edges are dropped.
    """
    e = edges.select(hub, other).where(F.col(hub).isNotNull() & F.col(other).isNotNull()).distinct()
    big = cut(e.groupBy(hub).agg(F.count("*").alias("n")).where(F.col("n") > most).select(hub, F.ceil(F.col("n") / most).cast("int").alias("parts")))
    if big.isEmpty():
        return e.select(other, hub)
    name = F.concat_ws("#", hub, F.pmod(F.xxhash64(other), F.col("parts")).cast("string"))
    dealt = e.join(big, hub, "left").select(other, F.when(F.col("parts").isNull(), F.col(hub)).otherwise(name).alias(hub))
    spokes = big.select(hub, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).select(F.concat_ws("#", hub, F.col("i").cast("string")).alias(other), hub)
    return dealt.unionByName(spokes)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component. edges: (a, b), either way; nodes: (node).

    Each round is two equi-joins and an aggregation over the nodes that have edges; the labels are cut from their lineage
    after every round. Nulls in edges are ignored; nodes without edges are their own component; empty inputs give no rows.
    """
    both = cut(edges.where("a is not null and b is not null").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a is not null and b is not null")).distinct())
    every = nodes.select("node").where("node is not null").distinct()
    labels = cut(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        new = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "old"))
        done = new.where("component <> old").isEmpty()
        labels = new.select("node", "component")
        if done:
            return every.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
