"""Sinks: JSON lines, readable text, line views, audits, reports, and a staged write that is promoted when complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def readable(df: DataFrame, path: str, title: str, text: str, rule: str = "=" * 40) -> None:
    """Records as text with a header and a separator."""
    df.select(F.concat_ws("\n", F.lit(rule), F.coalesce(title, F.lit("")), F.lit(rule), F.coalesce(text, F.lit(""))).alias("value")).write.mode("error").text(path)


def line_view(df: DataFrame, path: str, text: str) -> None:
    """Each line that isn't blank on its own line, for trainers that read lines."""
    lines = df.select(F.explode(F.split(text, r"\r?\n")).alias("value"))
    lines.where(F.regexp_replace("value", r"\s", "") != "").write.mode("error").text(path)


def rejected(df: DataFrame, path: str, tier: str = "tier", reasons: str = "reasons", text: str = "text") -> None:
    """Bodies and an index with the reasons of what was rejected."""
    bad = df.where(F.col(tier) == "reject")
    bad.drop(text).write.mode("error").parquet(f"{path}/index")
    bad.write.mode("error").parquet(f"{path}/bodies")


def table(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.coalesce(1).write.mode("error").option("header", "true").format(kind).save(path)


def report(parts: dict[str, DataFrame], path: str) -> None:
    """Small aggregates of one run as JSON rows, named by part."""
    for name, df in parts.items():
        df.coalesce(1).write.mode("error").json(f"{path}/{name}")


def promote(spark: SparkSession, staged: str, target: str, expected: list[str], overwrite: bool = False) -> None:
    """Move a staged release to its place if every expected item is there; an old one goes to target.backup first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = lambda p: hadoop.Path(p)
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    missing = [x for x in expected if not fs.exists(path(f"{staged}/{x}"))]
    if missing:
        raise FileNotFoundError(f"the staged release lacks {', '.join(missing)}")
    if fs.exists(path(target)):
        if not overwrite:
            raise FileExistsError(f"{target} exists")
        fs.delete(path(f"{target}.backup"), True)
        fs.rename(path(target), path(f"{target}.backup"))
    fs.rename(path(staged), path(target))
