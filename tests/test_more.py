"""Normalisation properties and group selection."""

import random

import pytest

from millrace.operators.normalize import normalize, normalized
from millrace.operators.ranking import ranked
from millrace.operators.selection import choose


def test_normalisation_is_idempotent():
    rng = random.Random(1)
    alphabet = "abیيىك هہـ‌‍‏ َّ ۔۔۔،!!!! \t\n\r  éé" + "﻿­.,"
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        once, _ = normalize(t)
        assert normalize(once) == (once, {})


def test_normalisation_reports():
    text, report = normalize("كتـاب  يہ ۔")
    assert text == "کتاب یہ۔" and report["kashida"] == 1 and report["letters"] == 2 and report["space_before_mark"] == 1
    assert normalize("") == ("", {})


def test_normalised_frame(spark):
    rows = {r.k: (r.text, r.report) for r in normalized(spark.createDataFrame([(1, "كـ"), (2, None)], "k int, t string"), "k", "t").collect()}
    assert rows[1][0] == "ک" and rows[2] == (None, {})


@pytest.mark.parametrize("target", [0, 7, 100])
def test_choose(target):
    h = {50: 1, 20: 3, 3: 4, 1: 2}
    got = choose(h, target)
    assert sum(s * n for s, n in got.items()) == min(target, 100) and all(n <= h[s] for s, n in got.items())


def test_ranks_of_hot_groups(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, f"v{i}") for i in range(600)], "g int, v string")
    rows = ranked(df, ["g"], "v", buckets=16).collect()
    hot = sorted(r["rank"] for r in rows if r.g == 0)
    assert hot == list(range(len(hot))) and len(rows) == 600


def test_contacts_and_chunks():
    from millrace.plans.extra_queries import chunk_lines, mask_contacts

    assert mask_contacts("mail a@b.co, ۰۳۰۱-۱۲۳۴۵۶۷ and 12345-1234567-1, 0991 123456") == ("mail <EMAIL>, <PHONE> and <ID_NUMBER>, <PHONE>", {"<EMAIL>": 1, "<PHONE>": 2, "<ID_NUMBER>": 1})
    assert mask_contacts("") == ("", {})
    got = chunk_lines(["a b", "c d", "head", "e f", "g h", "i j"], 3, lambda x: " " not in x)
    assert got == [["a b", "c d", "head", "e f", "g h", "i j"]] and chunk_lines([], 3, bool) == [[]]


def test_hierarchical_bootstrap_against_numpy(spark):
    """Clusters within source and seeds within candidate, 10,000 times; the seeds make most of the spread here."""
    import numpy as np

    from millrace.plans.stats_queries import _limits, hierarchical_reps

    g = np.random.default_rng(3)
    sizes, seeds, reps = {"a": 7, "b": 12}, 4, 10_000
    clusters = [(src, f"{src}{i}") for src, n in sizes.items() for i in range(n)]
    nbytes = g.integers(50, 150, len(clusters))
    bits = {c: nbytes * (1 + 0.3 * g.random(len(clusters)) + np.arange(seeds)[:, None] * 0.2) for c in ("x", "y")}
    rows = [(c, s, f"u{k}", float(b[s, k]), int(nbytes[k]), *clusters[k]) for c, b in bits.items() for s in range(seeds) for k in range(len(clusters))]
    x = spark.createDataFrame(rows, "candidate string, seed int, uid string, bits double, bytes long, source string, group_key string")
    r = hierarchical_reps(x)
    got = {v.candidate: v for v in _limits(r).collect()}
    for c, b in bits.items():
        w = np.zeros((reps, len(clusters)))
        for src in sizes:
            own = np.array([k for k, (z, _) in enumerate(clusters) if z == src])
            for q, drawn in enumerate(own[g.integers(0, len(own), (reps, len(own)))]):
                np.add.at(w[q], drawn, 1)
        m = np.array([np.bincount(z, minlength=seeds) for z in g.integers(0, seeds, (reps, seeds))])
        want = (m * (w @ b.T)).sum(1) / (seeds * (w @ nbytes))
        assert got[c].n_reps == reps and abs(got[c].mean_bpb - want.mean()) < 0.01
        assert abs(got[c].lo - np.quantile(want, 0.025)) < 0.03 and abs(got[c].hi - np.quantile(want, 0.975)) < 0.03 and got[c].hi - got[c].lo > 0.3
