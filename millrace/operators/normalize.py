"""Canonical normalisation as an ordered list of rules, each with the number of its changes; the whole is idempotent.

A rule is (name, text -> (text, changes)); the list is an extension point, and a profile is just another list. Null
stays null with an empty report.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Rule = tuple[str, Callable[[str], tuple[str, int]]]


def pattern(name: str, regex: str, to: str = "") -> Rule:
    r = re.compile(regex)
    return name, lambda t: r.subn(to, t)


def mapping(name: str, table: dict[str, str]) -> Rule:
    r = re.compile("[" + re.escape("".join(table)) + "]")
    return name, lambda t: r.subn(lambda m: table[m.group()], t)


def composed(t: str) -> tuple[str, int]:
    n = unicodedata.normalize("NFC", t)
    return n, int(n != t)


# The default profile's letters and signs.
DEFAULT: list[Rule] = [
    ("compose", composed),
    pattern("line_ends", r"\r\n?|[  \x85]", "\n"),
    pattern("controls", "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f﻿​‎‏‪-‮⁠-⁤⁦-⁩­]"),
    pattern("kashida", "ـ+"),
    mapping("letters", {"ي": "ی", "ى": "ی", "ك": "ک"}),
    pattern("joiners", "‍"),
    pattern("lone_non_joiners", r"(?:(?<=[\s.,;:!?()])|(?<![\s\S]))‌+|‌+(?=[\s.,;:!?()]|(?![\s\S]))|(?<=‌)‌+"),
    pattern("spaces", r"[^\S\n]+", " "),
    pattern("space_before_mark", r" +(?=[،۔؛؟!.,])"),
    pattern("repeated_marks", r"([،۔؛؟!])\1{2,}", r"\1\1"),
    pattern("line_edges", r"(?m)^ +| +$"),
    pattern("blank_lines", r"\n{3,}", "\n\n"),
    ("compose_again", composed),
]


def normalize(text: str, rules: list[Rule] = DEFAULT, rounds: int = 20) -> tuple[str, dict[str, int]]:
    """The text after the rules, repeated until nothing changes, and how often each changed it."""
    report: dict[str, int] = {}
    for _ in range(rounds):
        before = text
        for name, rule in rules:
            new, n = rule(text)
            if new != text:
                report[name] = report.get(name, 0) + n
                text = new
        if text == before:
            break
    return text, report


def normalized(df: DataFrame, key: str, text: str, rules: list[Rule] | None = None) -> DataFrame:
    """(key, text, report) of every row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(None, {}) if t is None else normalize(t, rules or DEFAULT) for t in b.column(text).to_pylist()]
            report = pa.array([list(r.items()) for _, r in got], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([t for t, _ in got], pa.string()), report], names=[key, "text", "report"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, text string, report map<string,bigint>")
