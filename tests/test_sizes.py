"""Joins whose sides are exploded: Spark estimates them far too small, so none of them may be broadcast on that estimate."""

import random
import re

import __spark_entry__ as entry
from millrace.plans.dedup_queries import best_partners


def joins(df) -> list[str]:
    """The joins of a query's plan by way and first key."""
    return re.findall(r"(\w+Join) \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())


def broadcast_keys(spark, name: str, folder: str) -> set[str]:
    """The keys of the broadcast joins of all jobs that a query runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    entry.queries()[name](spark, folder).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert plans
    keys = re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\]]*)\]", "\n".join(plans))
    return {k for x in keys for k in re.findall(r"(\w+)#", x)}


def test_d07_eval_containment_shuffles_its_grams(spark, folder):
    found = joins(entry.queries()["d07_eval_containment"](spark, folder))
    assert ("SortMergeJoin", "gram") in found and ("BroadcastHashJoin", "gram") not in found


def test_d11_raw_gram_check_shuffles_its_grams(spark, folder):
    found = joins(entry.queries()["d11_raw_gram_check"](spark, folder))
    assert ("SortMergeJoin", "gram") in found and ("BroadcastHashJoin", "gram") not in found


def test_d07_best_partner_broadcasts_no_grams(spark, folder):
    assert not broadcast_keys(spark, "d07_best_partner", folder) & {"gram", "partner", "class", "set"}


def test_best_partners_equal_those_of_all_pairs(spark):
    rng, hot = random.Random(5), range(6)
    draw = lambda: frozenset([*rng.sample(hot, rng.randint(0, 4)), *(min(int(rng.expovariate(0.05)), 200) for _ in range(rng.randint(1, 14)))])
    records, others = ({f"{side}{i:02d}": draw() for i in range(n)} for side, n in (("e", 60), ("t", 150)))
    others |= {f"u{k}": v for k, v in list(others.items())[:20]}  # equal sets: the least uid counts
    want = {}
    for u, a in records.items():
        if near := [(-len(a & b) / len(a | b), v) for v, b in others.items() if a & b]:
            want[u] = (min(near)[1], round(-min(near)[0], 4))
    rows = lambda side: spark.createDataFrame([(u, g, len(a)) for u, a in side.items() for g in a], "uid string, gram bigint, n int")
    for first in (1, 3):
        got = {r.uid: (r.partner, r.jaccard) for r in best_partners(rows(records), rows(others), first).collect()}
        assert got == want


def test_d20_fuzzy_line_copies_broadcasts_no_grams(spark, folder):
    assert not broadcast_keys(spark, "d20_fuzzy_line_copies", folder) & {"h", "doc_id", "line_no", "copy_of", "number"}


def test_f20_keep_rule_broadcasts_no_grams(spark, folder):
    assert not broadcast_keys(spark, "f20_keep_rule", folder) & {"h", "doc_id"}
