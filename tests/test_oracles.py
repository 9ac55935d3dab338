"""Every core query against its SQL on the smallest tables, and the plans' shapes."""

import math
from pathlib import Path

import pytest

from millrace.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    got = df.collect()
    res = db.execute(ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    assert sorted(tuple(canon(r[c]) for c in cols) for r in got) == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0


def test_pushdown_and_pruning(spark, folder):
    plan = QUERIES["f18_split_filter"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(source" in plan or "PushedFilters: [IsNotNull(quality_tier)" in plan
    assert "text" not in plan.split("ReadSchema: struct<")[1].split(">")[0]


def test_same_result_with_other_partitions(spark, folder):
    a = sorted(map(tuple, QUERIES["tiered_corpus_report"](spark, folder).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = sorted(map(tuple, QUERIES["tiered_corpus_report"](spark, folder).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
