"""Rules over lines and numbers on small fixtures: contacts, repeated runs, revisions, fuzzy copies, bridged gaps."""

import random

import pytest

from millrace.plans import extra_queries, line_queries, more_queries


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@mail.example.org now", "write to <EMAIL> now"),
        ("id 12345-1234567-1, old 123-45-678901.", "id <ID_NUMBER>, old <ID_NUMBER>."),
        ("call +92 3001234567 or 00965-12345678", "call <PHONE> or <PHONE>"),
        ("0300-1234567 / 03001234567 / 923001234567", "<PHONE> / <PHONE> / <PHONE>"),
        ("1234567-0300 and 1234567 300 reversed", "<PHONE> and <PHONE> reversed"),
        ("office 0992-381234, 381234 0992", "office <PHONE>, <PHONE>"),
        ("۰۳۰۰ ۱۲۳۴۵۶۷ اور ٠٣٠٠١٢٣٤٥٦٧", "<PHONE> اور <PHONE>"),
        ("CNIC No: 17301123456 ok", "CNIC No: <ID_NUMBER> ok"),
        ("شناختی کارڈ نمبر A-98765 تے", "شناختی کارڈ نمبر <ID_NUMBER> تے"),
        ("in 1976-1996 for 8,151,389 at 12:30, ISBN 978-0-00-561721-0", "in 1976-1996 for 8,151,389 at 12:30, ISBN 978-0-00-561721-0"),
        ("", ""),
        ("no digits\n0300-1234567\n", "no digits\n<PHONE>\n"),
    ],
)
def test_contacts(text, want):
    got, counts = extra_queries.mask_contacts(text)
    assert got == want and sum(counts.values()) == sum(want.count(k) for k in ("<EMAIL>", "<ID_NUMBER>", "<PHONE>"))


def _lines(spark, **texts):
    return spark.createDataFrame([(u, i, l) for u, ls in texts.items() for i, l in enumerate(ls)], "uid string, pos int, l string")


def test_repeated_runs_follow_the_rule(spark):
    long_ = [f"line {i} " + "x" * 220 for i in range(5)]
    short = [f"s{i}" for i in range(6)]
    far = [f"f{i}" for i in range(110)]
    got = {tuple(r) for r in more_queries.repeated_runs(_lines(spark, a=long_ + ["mid"] + long_, b=short + ["mid"] + short, c=far + far[:5], d=["same"] * 300, e=long_[:4] + ["mid"] + long_[:4])).collect()}
    # b is a chorus (short lines, near), d has one line only, e too few.
    assert got == {("a", 6, 6, 5), ("c", 110, 110, 5)}


def test_revisions_share_half_of_a_large_file(spark):
    body = [f"{i} " + "y" * 50 for i in range(60)]
    texts = [("big", "\n".join(body + [f"more {i} " + "z" * 50 for i in range(20)])), ("old", "\n".join(body)), ("part", "\n".join(body[:20])), ("none", "\n".join(f"{i} " + "w" * 50 for i in range(50)))]
    got = {r.site: r.canonical for r in more_queries.revision_clusters(spark.createDataFrame(texts, "site string, text string")).collect()}
    # part has under 2,000 characters, and half of no other file.
    assert got == {"big": "big", "old": "big", "part": "part", "none": "none"}


def test_fuzzy_copies_and_their_vetoes(spark):
    base = "the river ran past the old mill and the people of the valley came down to trade grain for cloth every spring"
    rows = [(1, base), (2, base.replace("mill", "miln")), (3, base + " and then a wholly different tale is told"), (4, base.replace("grain", "gra1n 77")), (5, "short line"), (6, base)]
    got = {(r.doc_id, r.copy_of, r.kept_because) for r in line_queries.fuzzy_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    by = {d: (c, k) for d, c, k in got}
    assert 2 in by and by[2][0] == 1 and 5 not in by and 6 not in by
    assert by.get(3, (None, "uncovered_text"))[1] == "uncovered_text" and (4 not in by or by[4][1] is not None)


def test_gaps_between_repeated_runs_are_bridged():
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(14))
    first = [line() for _ in range(15)]
    copy = list(first)
    copy[7] = copy[7][:20] + "Z" + copy[7][21:]
    other = [line() for _ in range(120)]
    got = line_queries.bridged(first + other + copy)
    at = len(first) + len(other) + 7
    assert [(g, best) for g, best, _ in got] == [(at, 7)]
    copy[7] = line()
    assert line_queries.bridged(first + other + copy) == [] and line_queries.bridged([]) == [] and line_queries.bridged(["a"] * 50) == []


def test_kept_line_index_grows_by_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"shared line\nown line {i % 7}") for i in range(30)], "doc_id bigint, text string")
    whole = {tuple(r) for r in line_queries.kept_lines(spark, rows, str(tmp_path / "a"), 1).collect()}
    parts = {tuple(r) for r in line_queries.kept_lines(spark, rows, str(tmp_path / "b"), 4).collect()}
    assert whole == parts and len(whole) == 8


def test_word_jaccard_against_all_pairs(spark):
    rng = random.Random(5)
    docs = []
    for i in range(40):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
        docs += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(x if rng.random() > 0.01 else "edit" for x in w)), (3 * i + 2, " ".join(w).upper() if i % 5 == 0 else None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in line_queries.jaccard_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    sets = {d: frozenset(tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)) for d, t in docs if t}
    sets = {d: s for d, s in sets.items() if s}
    first = {}
    for d, s in sorted(sets.items()):
        first.setdefault(s, d)
    links = {c: sum(1 for s, o in first.items() if o != c and 5 * len(s & own) >= 4 * len(s | own)) for own, c in first.items()}
    assert got == {d: (first[s], links[first[s]]) for d, s in sets.items()} and max(links.values()) > 0
