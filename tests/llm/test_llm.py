"""The training-data operators: brute force, round trips, held-out accuracy, and awkward input."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.io import table
from millrace.llm import abuse, furniture, langid, leaks, ocr, overlap, packing, pii, quality, sequences, splits, text
from millrace.llm.common import ranked
from millrace.llm.oracles import ORACLES
from millrace.llm.queries import QUERIES

KEY = b"a key for tests"

BUILD = (
    "id string, uid string, text string, language string, source string, source_file string, title string, date string, date_precision string, source_path string, issue string, "
    "extraction_method string, language_variety string, emitted_at timestamp, src string, furniture string, keys string, whole string, h string"
)


def build(spark, rows):
    """Rows of build, with columns whose names the operators use themselves."""
    names = [c.split()[0] for c in BUILD.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], BUILD)


def manifest(spark, rows):
    return spark.createDataFrame(rows, "uid string, split string, whole string")


GATES = "id string, attr string, component string"
PARTS = "name string, kind string, script string, text string"


def parts(spark):
    given = [a + b for a in ("Zarm", "Torb", "Gul") for b in ("una", "akh", "iab")]
    family = [a + b for a in ("Bijo", "Morr", "Sair") for b in ("vati", "zaiel")] + ["Tarnvati"]
    return spark.createDataFrame([*((n, "given", "latn", None) for n in given), *((n, "family", "latn", None) for n in family), (None, None, None, None)], PARTS)


def fold(t):
    t = unicodedata.normalize("NFKD", t).casefold()
    t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Mc") and c != "ـ")
    return t.translate(str.maketrans("يىكهھە٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ییکہہہ01234567890123456789"))


# --- text ------------------------------------------------------------------------------------------------------------


def test_words_and_lines_against_plain_python():
    rng = random.Random(1)
    alphabet = "abcdé شہربكيهٱآ ۱٢3 \n\t-_،۔‌ًـ😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["", "\n", "ـ", "a"]
    col = pa.array([*texts, None])
    cp, start = text.codes(col)
    w = text.words(cp, start, lines=True)
    keys, ls = text.line_keys(cp, start)
    s = w.folded.tobytes().decode("utf-32-le")
    seen = {}
    for i, t in enumerate(texts):
        assert cp[start[i] : start[i + 1]].tobytes().decode("utf-32-le") == t
        got = [s[a:b] for a, b in zip(w.fold_first[w.start[i] : w.start[i + 1]], w.fold_end[w.start[i] : w.start[i + 1]], strict=True)]
        assert got == re.findall(r"[^\W_]+", fold(t))
        lines = t.split("\n")
        assert ls[i + 1] - ls[i] == len(lines)
        for k, line in zip(keys[ls[i] : ls[i + 1]].tolist(), lines, strict=True):
            letters = "".join(c for c in fold(line) if c.isalpha())
            assert (k == 0) == (letters == "")
            assert seen.setdefault(letters, k) == k
    assert len(set(seen.values())) == len(seen)


def test_chunks_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": ["x" * 100, None, "y" * 10, "z" * 5000, ""]})
    got = list(text.chunks(iter([b]), "text", 150))
    assert sum(c.num_rows for c in got) == 5 and max(c.num_rows for c in got) < 5
    assert list(text.chunks(iter([b.slice(0, 0)]), "text")) == []


def test_ranks(spark):
    df = spark.createDataFrame([(g, i) for i in range(200) for g in (1, 2) if i % g == 0], "g int, v int")
    rows = ranked(df, ["g"], "v", buckets=8).collect()
    for g in (1, 2):
        own = sorted(r["rank"] for r in rows if r.g == g)
        assert own == list(range(len(own)))


# --- empty, null, repeated and very long input -------------------------------------------------------------------


AWKWARD = [
    {},
    {"uid": "a"},
    {"uid": "b", "text": "", "source": "web", "source_path": "web/x/1.json"},
    {"uid": "c", "text": "\n\n \n", "source": "newspaper", "source_path": "news.INP", "issue": ""},
    {"uid": "d", "text": "word " * 60_000, "source": "book", "source_path": "book/farma 1/p.INP", "extraction_method": "ocr"},
    {"uid": "d", "text": "word " * 60_000, "source": "book", "source_path": "book/farma 1/p.INP", "extraction_method": "ocr"},
    {"uid": "e", "text": "😀 one\x00two ‌ \r\n x", "source": "odd", "source_path": "\\\\", "language_variety": " "},
    {"uid": "f", "text": "Mr. " + "a" * 50_000 + "@" + "b" * 50_000, "source": "newspaper", "source_path": "newspaper/s/volume 1/p 1.INP", "issue": "none"},
]


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["empty", "awkward"])
def test_build_operators_survive(spark, rows):
    b, p = build(spark, rows), parts(spark)
    m = manifest(spark, [("d", "train", None), ("d", "train", None), ("e", "test", None), (None, "test", None), ("f", None, None)] if rows else [])
    g = spark.createDataFrame([("A1-x", None, None), ("a01 y", None, None), (None, None, None)] if rows else [], GATES)
    rec = furniture.line_sequences(b)
    often = furniture.frequent_lines(rec)
    assert often.count() == 0 and furniture.prefix_span(rec, often).count() == 0
    assert furniture.occurrences(rec, often).count() == 0
    assert furniture.remove(b, often).count() == len(rows)
    st = {r.uid: r for r in quality.statistics(b, often).collect()}
    if rows:
        assert st["a"].n_words == 0 and st["a"].prose_share is None and st["d"].n_words == 60_000
    assert {r.uid for r in quality.not_prose(b, often).collect()} <= {"d", "e", "f"}
    assert {tuple(r) for r in splits.found(b, g).collect()} == ({("run:A1-x", "run:a01 y")} if rows else set())
    assert splits.assign(b, g).count() == (8 if rows else 0)
    assert overlap.found(b, m, often).count() == 0 and overlap.report(b, m, often).count() <= 1
    pii.found(b, p).collect()
    assert pii.mask(b, p).count() == len(rows)
    ocr.found(b, p).collect()
    assert ocr.repair(b, p).count() == (6 if rows else 0)
    langid.found(b, often, p).collect()


def test_document_operators_survive(spark):
    docs = "doc_id bigint, text string, source string, lang string, size bigint, rank bigint, score double, found bigint"
    rows = [(1, None, None, None, None, None, None, None), (None, "x", "s", "en", 1, 1, 1.0, 1), (2, "", "s", "en", 1, 1, 1.0, 1), (3, "many words " * 20_000, "s", None, 1, 1, 1.0, 1), (3, "many words " * 20_000, "s", None, 1, 1, 1.0, 1), (4, "x", "s", "en", 1, 1, 1.0, 1)]
    boxes = spark.createDataFrame([(1, 64), (2, 64), (3, None), (4, 0)], "container_id int, capacity_tokens bigint")
    items = spark.createDataFrame([(1, None), (None, "a b"), (2, "short"), (3, "many words " * 9), (3, "many words " * 9)], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, "a", None, "none"), (None, "b", 1, "x"), (4, "c", 0, "none")], "doc_id bigint, annotator string, abusive int, category string")
    terms = spark.createDataFrame([(None,), ("vermin",)], "term string")
    for some in (rows, []):
        d = spark.createDataFrame(some, docs)
        assert [tuple(r) for r in packing.found(d, boxes).collect()] == ([(64, 3)] if some else [])
        assert packing.pack_all(d, boxes).count() == (3 if some else 0)
        assert packing.report(d, boxes).count() == (1 if some else 0)
        assert [tuple(r) for r in leaks.leaked(d, items).collect()] == ([(3, 3)] if some else [])
        assert abuse.found(d, labels, terms).count() == 0
        assert abuse.report(d, labels, terms).count() == (1 if some else 0)
    assert packing.pack_all(spark.createDataFrame(rows, docs), boxes.where("false")).count() == 0
    assert leaks.leaked(spark.createDataFrame(rows, docs), items.where("false")).count() == 0
    assert abuse.found(spark.createDataFrame(rows, docs), labels.where("false"), terms.where("false")).count() == 0


# --- p1 ----------------------------------------------------------------------------------------------------------


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    k, first, move = 3, rng.random(3), rng.random((3, 3))
    sizes = [4, 0, 1, 3]
    start = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.random((sum(sizes), k))
    post, moves, _ = sequences.forward_backward(score, start, first, move)
    want, want_moves = np.zeros_like(score), np.zeros((k, k))
    for a, n in zip(start[:-1], sizes, strict=True):
        if not n:
            continue
        paths = {p: first[p[0]] * np.prod([score[a + t, x] for t, x in enumerate(p)]) * np.prod([move[x, y] for x, y in itertools.pairwise(p)]) for p in itertools.product(range(k), repeat=n)}
        z = sum(paths.values())
        for p, v in paths.items():
            for t, x in enumerate(p):
                want[a + t, x] += v / z
            for x, y in itertools.pairwise(p):
                want_moves[x, y] += v / z
    assert np.allclose(post, want) and np.allclose(moves, want_moves)


def test_quality_tells_prose_from_lists(spark):
    prose = "\n".join("The people of the town said that their book was kept in a house by the road." for _ in range(6))
    rows = [{"uid": f"p{i}", "text": prose, "source": "book", "source_path": "book/a/1"} for i in range(4)]
    rows += [{"uid": "list", "text": "\n".join(f"{i}. tomato carrot" for i in range(20)), "source": "web", "source_path": "web/a/1"}]
    rows += [{"uid": "table", "text": "\n".join(f"item{i}\t{i * 7}\t{i * 13}\t9.5" for i in range(20)), "source": "web", "source_path": "web/a/2"}]
    rows += [{"uid": "junk", "text": "\n".join("spam spam spam spam spam spam spam spam" for _ in range(20)), "source": "web", "source_path": "web/a/3"}]
    rows += [{"uid": "mixed", "text": prose + "\n- one\n- two\n- three", "source": "web", "source_path": "web/a/4"}]
    b = build(spark, rows)
    none = furniture.frequent_lines(furniture.line_sequences(b.where("false")))
    assert {r.uid for r in quality.not_prose(b, none).collect()} == {"list", "table", "junk"}


# --- p2 ----------------------------------------------------------------------------------------------------------


def closed_runs(seqs, least):
    """Brute force: the runs of lines (0 left out) of each record, those without a longer one of as many records."""
    count = Counter()
    for s in seqs:
        s = [x for x in s if x]
        count.update({tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)})
    often = {p: n for p, n in count.items() if n >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    return {p: n for p, n in often.items() if not any(len(q) == len(p) + 1 and m == n and inside(p, q) for q, m in often.items())}


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_prefix_span_against_all_runs(spark, seed):
    rng = random.Random(seed)
    seqs = [[rng.choice([11, 12, 13, 0]) for _ in range(rng.randrange(0, 7))] + rng.choice([[], [21, 22, 23, 24], [21, 22, 0, 23, 24, 21, 22]]) for _ in range(40)]
    rec = spark.createDataFrame([(f"u{i}", "s", s) for i, s in enumerate(seqs)], "uid string, src string, keys array<bigint>")
    often = furniture.frequent_lines(rec, 4, 0.1)
    got = {tuple(r.pattern): r.n_records for r in furniture.prefix_span(rec, often, 4, 0.1).collect()}
    # Lines that aren't frequent don't count between others.
    lines = {r.key for r in often.collect()}
    assert got == closed_runs([[x for x in s if x in lines] for s in seqs], 4)
    assert {r.key for r in furniture.sequence_lines(rec, often).collect()} == lines


def test_long_blocks_of_lines_stay_cheap(spark):
    """Thirty lines that a source's records share give one sequence; with lines missing at random, far fewer than subsets."""
    rng = random.Random(7)
    block = list(range(1000, 1030))
    for share in (1.0, 0.9):
        seqs = [[x for x in block if rng.random() < share] for _ in range(30)]
        rec = spark.createDataFrame([(f"u{i}", "s", s) for i, s in enumerate(seqs)], "uid string, src string, keys array<bigint>")
        got = {tuple(r.pattern): r.n_records for r in furniture.prefix_span(rec, furniture.frequent_lines(rec)).collect()}
        assert got == ({tuple(block): 30} if share == 1.0 else closed_runs(seqs, 4))


def test_furniture_is_found_and_removed(spark):
    rows = [{"uid": f"{i}", "text": f"All rights reserved 20{i:02d}\nown line number {chr(97 + i)}", "source": "web", "source_path": f".\\Web//Site/{i}.json"} for i in range(10)]
    rows += [{"uid": f"b{i}", "text": "All rights reserved", "source": "book", "source_path": "book/x/1"} for i in range(5)]
    rows.append({**rows[0]})
    b = build(spark, rows)
    rec = furniture.line_sequences(b)
    often = furniture.frequent_lines(rec)
    # Lines that differ in digits or one letter only are one and ten lines.
    assert sorted(tuple(r) for r in furniture.occurrences(rec, often).collect()) == [(str(i), 0) for i in range(10)]
    out = {r.uid: (r.text, r.lines_removed) for r in furniture.remove(b, often).collect()}
    assert out["3"] == ("own line number d", 1) and out["b1"] == ("All rights reserved", 0)


# --- p3 ----------------------------------------------------------------------------------------------------------


def test_allocation_is_whole_and_close():
    rng = random.Random(6)
    bundles = [(p, s, rng.randrange(1, 30)) for p in ("book", "run") for s in (1, 2, 3, 7, 20)]
    takes = splits.allocate(bundles)
    total = sum(s * c for _, s, c in bundles)
    got = [0, 0, 0]
    for (_, s, c), t in zip(bundles, takes, strict=True):
        assert sum(t) == c and min(t) >= 0
        for k in range(3):
            got[k] += s * t[k]
    assert all(abs(g - q * total) <= 20 for g, q in zip(got, (0.9, 0.05, 0.05), strict=True))
    big = splits.allocate([("book", 1000, 1), ("book", 1, 60)])
    assert big[0] == [1, 0, 0]


def test_related_records_share_a_split(spark):
    rows = [{"uid": f"n{i}", "source": "newspaper", "source_path": f"Newspaper\\Koh_1/volume 2/p {i}.INP", "issue": x, "date": "2004-12-05", "date_precision": p} for i, (x, p) in enumerate([("Issue No. 07", "day"), ("۷", None), ("8", "day"), ("9", "month")])]
    rows += [{"uid": "d", "source": "newspaper", "source_path": "newspaper/koh_1/2004 december/۵.۱۲.۲۰۰۴ ads/p 1.INP"}]
    rows += [{"uid": f"k{i}", "source": "book", "source_path": f"book/{f}/1.INP"} for i, f in enumerate(["farma 3", "FARMA-03 backup", "farma 4"])]
    b = build(spark, rows)
    g = spark.createDataFrame([("R1-A12-x", None, None), ("r2_a012_y", None, None), ("DA12", None, None)], GATES)
    pairs = {tuple(r) for r in splits.found(b, g).collect()}
    assert pairs == {
        ("dir:newspaper/koh_1/2004 december/۵.۱۲.۲۰۰۴ ads", "issue:koh_1:7"), ("dir:newspaper/koh_1/2004 december/۵.۱۲.۲۰۰۴ ads", "issue:koh_1:8"), ("issue:koh_1:7", "issue:koh_1:8"),
        ("dir:book/farma 3", "dir:book/farma-03 backup"), ("run:R1-A12-x", "run:r2_a012_y"),
    }
    by = defaultdict(set)
    for r in splits.assign(b, g).collect():
        by[r.component].add(r.split)
    assert all(len(x) == 1 for x in by.values())


# --- p4 ----------------------------------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_alignment():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        assert overlap.common_in_order(a, b) == lcs(a, b)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(8)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = {f"t{i:02d}": [rng.choice(vocab) for _ in range(rng.randrange(4, 120))] for i in range(30)}
    for i in range(15):
        w = list(texts[f"t{i:02d}"])
        for j in range(0, len(w), rng.choice([9, 15, 40])):
            w[j] = "changed"
        texts[f"v{i:02d}"] = w
    texts["vcopy"], texts["vdrop"] = list(texts["t20"]), texts["t21"][: int(len(texts["t21"]) * 0.9)]
    rows = [{"uid": u, "text": " ".join(w).upper() + "۔", "source": "book", "source_path": "book/a/1"} for u, w in texts.items()]
    m = manifest(spark, [(u, "train" if u[0] == "t" else "test", None) for u in texts])
    b = build(spark, [*rows, rows[0]])
    none = furniture.frequent_lines(furniture.line_sequences(b.where("false")))
    got = {tuple(r) for r in overlap.found(b, m, none).collect()}
    want = {(t, v) for t in texts for v in texts if t[0] == "t" and v[0] == "v" and lcs(texts[t], texts[v]) >= 0.8 * max(len(texts[t]), len(texts[v]))}
    assert ("t20", "vcopy") in want and got == want


def edited(rng, words, n):
    """words with n of them replaced by words of no other text."""
    w = list(words)
    for j in rng.sample(range(len(w)), n):
        w[j] = "x" + "".join(chr(97 + rng.randrange(26)) for _ in range(9))
    return w


def test_overlaps_of_a_family_of_edited_texts(spark):
    """More edited variants of one text than HOT: what they share are hot seeds only."""
    rng = random.Random(21)
    template = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    texts = {f"{'t' if i < 6 else 'v'}{i:04d}": edited(rng, template, 12) for i in range(3 * overlap.HOT)}
    b = build(spark, [{"uid": u, "text": " ".join(w), "source": "book", "source_path": "book/a/1"} for u, w in texts.items()])
    m = manifest(spark, [(u, "train" if u[0] == "t" else "test", None) for u in texts])
    none = furniture.frequent_lines(furniture.line_sequences(b.where("false")))
    got = {tuple(r) for r in overlap.found(b, m, none).collect()}
    want = {(t, v) for t in texts for v in texts if t[0] == "t" and v[0] == "v" and overlap.common_in_order(texts[t], texts[v]) >= 0.8 * 150}
    assert len(want) > 4 * overlap.HOT and got == want


def test_overlaps_of_evenly_edited_texts(spark):
    """Every sixth to ninth word changed: hardly any two fingerprints in a row survive."""
    rng = random.Random(22)
    texts = {}
    for i in range(120):
        w = [f"w{rng.randrange(10**6)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rng.choice([20, 40, 65, 80, 100]))]
        step = rng.choice([6, 7, 8, 9])
        texts[f"t{i:03d}"], texts[f"v{i:03d}"] = w, [f"x{x}" if j % step == step // 2 else x for j, x in enumerate(w)]
    # Texts of few different seeds, and one of a single word.
    texts |= {"t900": ["ha"] * 60, "v900": ["ha"] * 55, "t901": ["ha", "ho"] * 40, "v901": ["ha", "ho"] * 36 + ["hu"], "t902": ["one"], "v902": ["one"]}
    b = build(spark, [{"uid": u, "text": " ".join(w), "source": "book", "source_path": "book/a/1"} for u, w in texts.items()])
    m = manifest(spark, [(u, "train" if u[0] == "t" else "test", None) for u in texts])
    none = furniture.frequent_lines(furniture.line_sequences(b.where("false")))
    got = {tuple(r) for r in overlap.found(b, m, none).collect()}
    want = {(t, v) for t in texts for v in texts if t[0] == "t" and v[0] == "v" and overlap.common_in_order(texts[t], texts[v]) >= 0.8 * max(len(texts[t]), len(texts[v]))}
    assert len(want) >= 120 and got == want


def test_seeds_survive_edits():
    """Of pairs with 80 to 90 % of their words in common, at every length and kind of edit, at most 3 % share too few seeds."""
    rng = np.random.default_rng(5)
    for n in (6, 20, 40, 63, 64, 100, 150, 300, 700):
        for every in (5, 6, 8, None):
            a = [rng.integers(1, 1 << 62, n).astype(np.uint64) for _ in range(100)]
            b = [x.copy() for x in a]
            for x in b:
                at = np.arange(rng.integers(every), n, every) if every else rng.choice(n, int(n * 0.195), replace=False)
                x[at] = rng.integers(1, 1 << 62, len(at))
            start = np.arange(101) * n
            (sa, ia), (sb, ib) = (overlap.seeds_of(np.concatenate(x), start) for x in (a, b))
            close = [i for i in range(100) if overlap.common_in_order(a[i].tolist(), b[i].tolist()) >= 0.8 * n]
            few = [len(np.intersect1d(sa[ia[i] : ia[i + 1]] >> np.uint64(16), sb[ib[i] : ib[i + 1]] >> np.uint64(16))) * (2 if n < overlap.FEW else 1) < overlap.NEEDED for i in close]
            assert sum(few) <= 0.05 * max(20, len(close)), (n, every)


def test_seeds_of_a_batch_are_those_of_each_text():
    rng = np.random.default_rng(6)
    texts = [rng.integers(1, 40, n).astype(np.uint64) for n in (0, 1, 2, 5, 30, 70, 0, 400)]
    start = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    s, at = overlap.seeds_of(np.concatenate(texts), start)
    for i, x in enumerate(texts):
        own, _ = overlap.seeds_of(x, np.array([0, len(x)]))
        assert s[at[i] : at[i + 1]].tolist() == own.tolist()


def test_chain_extended_by_alignment():
    rng = random.Random(9)
    for _ in range(60):
        a = [rng.randrange(1, 60) for _ in range(rng.randrange(0, 90))]
        b = [rng.randrange(1, 60) if rng.random() < 0.12 else x for x in a if rng.random() > 0.05]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        links = overlap.chain(x, y)
        assert all(p < q and r < t for (p, r), (q, t) in zip(links, links[1:], strict=False))
        exact = lcs(a, b)
        assert overlap.extended(x, y) <= exact
        need = 0.8 * max(len(a), len(b))
        assert (overlap.alignment(x, y) >= need) == (exact >= need)


# --- p5 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", range(2, 16))
def test_feistel_is_a_permutation(n):
    rng = random.Random(n)
    xs = {"".join(rng.choice("0123456789") for _ in range(n)) for _ in range(200)}
    ys = {pii.feistel(x, KEY) for x in xs}
    assert len(ys) == len(xs) and all(len(y) == n for y in ys)
    assert all(pii.unfeistel(pii.feistel(x, KEY), KEY) == x for x in xs)
    if n == 2:
        assert len({pii.feistel(f"{i:02d}", KEY) for i in range(100)}) == 100


def test_personal_data_is_found(spark):
    names = pii._names(parts(spark))
    t = (
        "Write to a.b-1@mail.example or x [at] y [dot] test, call 0399-1234567 or ۰۳۹۹۱۲۳۴۵۶۷۸, id 12345-1234567-1 and ١٢٣٤٥٦٧٨٩٠١٢٣. "
        "Mr. Zarmuna Torbakh Bijovati and GULIAB MORRZAIEL came. House 5, Street 7, Mohalla Abc, Town. "
        "ISBN 978-0-00-561721-0 price 8,151,389 in 1976-1996, K-4855-76, @handle."
    )
    got = pii.find(pa.array([None, t, ""]), names)
    kinds = Counter(k for _, k, *_ in got)
    assert kinds["email"] == 2 and kinds["id_number"] == 2 and kinds["person"] == 2 and kinds["address"] == 1 and all(r == 1 for r, *_ in got)
    found = {t[a:b] for _, _, a, b, _ in got}
    assert {"Zarmuna Torbakh Bijovati", "a.b-1@mail.example", "0399-1234567", "House 5, Street 7, Mohalla Abc, Town"} <= found


def test_pseudonyms_keep_the_form_and_link():
    forms = ["0399-1234567", "+92 399 1234567", "0092-399-1234567", "0399.123.4567", "1234567-0399", "(0399) 123 45 67"]
    fake = [pii.pseudonym("phone", f, KEY) for f in forms]
    shape = lambda x: re.sub(r"\d", "9", x)
    assert [shape(x) for x in fake] == [shape(x) for x in forms]
    assert len({pii.canonical("phone", x) for x in fake}) == 1 and all("399" in x and pii.valid("phone", x) for x in fake)
    a, b = (pii.pseudonym("id_number", x, KEY) for x in ("12345-1234567-1", "1-1234567-12345"))
    assert re.fullmatch(r"1\d{4}-\d{7}-\d", a) and re.fullmatch(r"\d-\d{7}-1\d{4}", b) and pii.canonical("id_number", a) == pii.canonical("id_number", b) != "1234512345671"
    assert pii.placeholder("email", "A@B.test", KEY) == pii.placeholder("email", "a [at] b [dot] test", KEY) != pii.placeholder("email", "A@B.test", b"other")
    assert len({pii.pseudonym("phone", f"0399-{i:07d}", KEY) for i in range(2000)}) == 2000


def test_days_are_permuted_within_their_form():
    days = [pii.FIRST_DAY + pii.timedelta(i) for i in range(3000)]
    new = {pii.permuted_day(d, KEY) for d in days}
    assert len(new) == 3000 and all(pii.FIRST_DAY <= d <= pii.LAST_DAY for d in new)
    assert re.fullmatch(r"\d\d/\d\d/(?:19|20)\d\d", pii.pseudonym("date", "03/04/1981", KEY))
    x, y = pii.pseudonym("date", "3-4-1981", KEY), pii.pseudonym("date", "1981.04.03", KEY)
    assert [int(n) for n in x.split("-")] == [int(n) for n in y.split(".")][::-1]
    assert pii.pseudonym("date", "31-02-1981", KEY) == "00-00-0000"


def test_recall_and_precision_by_kind(spark):
    """Planted items of every kind and style among decoys: at least 0.95 of each are found, and of what is found."""
    rng = random.Random(31)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = {
        "phone": lambda: rng.choice([f"0399-{n(7)}", f"+92 399 {n(7)}", f"0092-399-{n(7)}", f"(0399) {n(3)} {n(2)} {n(2)}", f"0399.{n(3)}.{n(4)}", f"0399{n(7)}".translate(str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹"))]),
        "id_number": lambda: rng.choice([f"1{n(4)}-{n(7)}-{n(1)}", f"{n(1)}-{n(7)}-3{n(4)}", f"2{n(12)}", f"{n(3)}-{n(2)}-{n(6)}"]),
        "email": lambda: rng.choice([f"user{n(3)}@mail.example", f"a.b{n(2)}[at]site.test", f"u{n(2)} @ box.example"]),
        "address": lambda: rng.choice([f"House {n(2)}, Street {n(1)}", f"مکان نمبر {n(2)}، گلی نمبر {n(1)}", f"Flat {n(2)}, Noor Plaza"]),
        "person": lambda: rng.choice(["Zarmuna Bijovati", "GULIAB MORRZAIEL", "Torbakh Sairvati"]),
    }
    decoys = [lambda: f"price {n(1)},{n(3)},{n(3)}", lambda: f"ISBN 978-0-{n(2)}-{n(6)}-{n(1)}", lambda: f"in 19{n(2)}-20{n(2)}", lambda: f"K-{n(4)}-{n(2)}", lambda: f"{n(2)}/{n(2)}/19{n(2)}", lambda: "@handle"]
    texts, want = [], set()
    for row in range(300):
        t = "words"
        for _ in range(6):
            kind = rng.choice([*make, None, None])
            item = make[kind]() if kind else rng.choice(decoys)()
            t += rng.choice([" and ", " then ", ", "])
            if kind:
                want.add((row, kind, len(t)))
            t += item
        texts.append(t + " end")
    got = {(r, k, a) for r, k, a, _, _ in pii.find(pa.array(texts), pii._names(parts(spark)))}
    for kind in make:
        w, g = ({x for x in y if x[1] == kind} for y in (want, got))
        assert len(w & g) >= 0.95 * len(w) and len(w & g) >= 0.95 * len(g), (kind, sorted(w ^ g)[:5])


def test_masks_link_documents(spark):
    rows = [{"uid": "a", "text": "call 0399-1234567, born 3-4-1981"}, {"uid": "b", "text": "+92 399 1234567 on 3-4-1981"}]
    p = {r.uid: r for r in pii.mask(build(spark, rows), parts(spark), KEY).collect()}
    number = [pii.canonical("phone", re.search(r"<PHONE:([^>]*)>", p[u].text)[1]) for u in "ab"]
    assert number[0] == number[1] and p["a"].pii_masked == {"<PHONE>": 1, "<DATE>": 1} and p["b"].text.endswith("on 3-4-1981")


def test_offsets_are_of_the_original(spark):
    t = "ن‌ًـ x 0399-1234567 y"
    ((_, kind, a, b, _),) = pii.find(pa.array([t]), pii._names(parts(spark)))
    assert kind == "phone" and t[a:b] == "0399-1234567"
    out = pii.mask(build(spark, [{"uid": "u", "text": t}]), parts(spark)).first()
    assert out.text.startswith("ن‌ًـ x <PHONE:") and out.pii_masked == {"<PHONE>": 1}


# --- p6 ----------------------------------------------------------------------------------------------------------


def test_line_kinds():
    lines = ["Blue river tale    12", "the people of the town have gone to the mar-", "ket by the road", "- 12 -", "صفحہ ۱۲", "13 / 200"]
    kinds, broken, scanned = ocr.line_kinds(lines, True)
    assert kinds == ["header", None, None, "page_no", "page_no", "page_no"] and broken == [False, True, False, False, False, False] and scanned
    assert ocr.line_kinds(["One sentence in a line."], True)[2] is False


def test_delete_index_meets_all_near_words():
    rng = random.Random(9)
    for _ in range(200):
        w = "".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 10)))
        i = rng.randrange(len(w))
        for x in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :], w[:i] + "z" + w[i:]):
            assert set(ocr.deletes(w)) & set(ocr.deletes(x))
    assert ocr.distance("modern", "modem") == 0.5 and ocr.distance("cat", "cot") == 1.0 and ocr.distance("c@t", "cat") == 0.5


def test_scans_are_repaired(spark):
    clean = "The people of the village have a market by the river and the road. Every house that has a garden was kept."
    rows = [{"uid": f"c{i}", "text": clean, "source": "web", "source_path": "web/a/1"} for i in range(6)]
    scan = "River tale song    7\nThe pe0ple of the village have a mar-\nket by the river and the r~ad. Every\nhouse that has a garden was kept.\n- 7 -"
    rows.append({"uid": "s", "text": scan, "source": "book", "source_path": "book/a/1"})
    b = build(spark, rows)
    got = sorted(tuple(r) for r in ocr.found(b, parts(spark)).collect())
    assert got == [("s", 0, "header"), ("s", 1, "hyphen"), ("s", 1, "ocr_char"), ("s", 2, "ocr_char"), ("s", 4, "page_no")]
    other = build(spark, [*rows, {"uid": "s", "text": "A", "source": "book", "source_path": "book/a/1"}])
    assert {r.text for r in ocr.repair(other, parts(spark)).where("uid = 's'").collect()} == {"A"}
    fixed = {r.uid: r.text for r in ocr.repair(b, parts(spark)).collect()}
    assert fixed["s"] == clean and fixed["c1"] == clean


def test_long_words_meet_in_their_thirds():
    rng = random.Random(12)
    for n in (39, 40, 41, 42, 43, 90):
        w = "".join(rng.choice("abcdef") for _ in range(n))
        i, j = sorted(rng.sample(range(n), 2))
        for x in (w[:i] + w[i + 1 : j] + w[j + 1 :], w[:i] + "z" + w[i + 1 : j] + "z" + w[j + 1 :], w[:i] + "z" + w[i:j] + "z" + w[j:], w[:i] + w[i + 1 : j] + "z" + w[j:]):
            assert set(ocr.deletes(x)) & set(ocr.deletes(w, suspect=False)), (n, i, j)


def test_accuracy_of_repairs(spark):
    """Planted damage in scanned books: nearly all of it is undone, and hardly a sound word is changed."""
    rng = random.Random(41)
    syllable = ["ba", "do", "ker", "lim", "nor", "sto", "tan", "vel", "mer", "gid", "hus", "pol"]
    nouns = ["".join(rng.choice(syllable) for _ in range(rng.choice([2, 3, 3, 4]))) for _ in range(150)]
    sentence = lambda: f"the {rng.choice(nouns)} of the {rng.choice(nouns)} was in our {rng.choice(nouns)} and it had been near the {rng.choice(nouns)} for a {rng.choice(nouns)}."
    rows = [{"uid": f"c{i}", "text": "\n".join(" ".join(sentence() for _ in range(4)) for _ in range(3)), "source": "web", "source_path": "web/a/1"} for i in range(120)]
    want, planted = {}, 0
    for k in range(40):
        text = " ".join(sentence() for _ in range(12))
        want[f"s{k}"] = text.split()
        ws = []
        for w in text.split():
            if len(w) > 5 and w.isalpha() and rng.random() < 0.12:
                i = rng.choice([i for i, c in enumerate(w) if c in "oel"] or [0])
                if w[i] in "oel":
                    w, planted = w[:i] + {"o": "0", "e": "c", "l": "1"}[w[i]] + w[i + 1 :], planted + 1
            ws.append(w)
        lines = [""]
        for w in ws:
            if len(lines[-1]) + len(w) > 60:
                if len(w) > 7 and w.isalpha():
                    lines[-1] += f" {w[:4]}-"
                    lines.append(w[4:])
                    continue
                lines.append("")
            lines[-1] = f"{lines[-1]} {w}".strip()
        body = ["Bakernor Dotan Vellim   " + str(k), *lines[:9], f"- {k + 1} -", *lines[9:]]
        rows.append({"uid": f"s{k}", "text": "\n".join(body), "source": "book", "source_path": f"book/b/{k}", "extraction_method": "ocr"})
    got = {r.uid: r.text.split() for r in ocr.repair(build(spark, rows), parts(spark)).where("uid like 's%'").collect()}
    wrong = sum(sum((Counter(want[u]) - Counter(got[u])).values()) for u in want)
    extra = sum(sum((Counter(got[u]) - Counter(want[u])).values()) for u in want)
    left = [((Counter(want[u]) - Counter(got[u])), (Counter(got[u]) - Counter(want[u]))) for u in want if Counter(want[u]) != Counter(got[u])]
    assert planted > 150 and wrong <= 0.1 * planted and extra <= 0.1 * planted, (planted, wrong, extra, left)


# --- p7 ----------------------------------------------------------------------------------------------------------


def test_islands_join_their_passage():
    label = np.array([0] * 10 + [1] * 3 + [0] * 10 + [2] * 8 + [1] * 2)
    assert langid.runs(label, np.array([0, len(label)])) == [(0, 0, 0, 23), (0, 2, 23, 33)]
    assert langid.runs(np.zeros(0, int), np.array([0])) == []


def test_gradient_of_the_field():
    """The gradient is that of the likelihood, unlabelled words summed over: compared with finite differences."""
    rng = np.random.default_rng(13)
    words_ = ["ka", "dey", "ast", "the", "نال", "میں"]
    lists_ = [langid.features(w) for w in words_]
    ids, start = rng.integers(0, 6, 14), np.array([0, 5, 5, 14])
    gold = np.where(rng.random(14) < 0.6, rng.integers(0, 5, 14), -1)
    f = langid.Field()
    f.weight, f.move, f.first = rng.normal(0, 0.3, f.weight.shape), rng.normal(0, 0.3, f.move.shape), rng.normal(0, 0.3, f.first.shape)
    _, grads = f.likelihood(lists_, ids, start, gold)
    for x, g in zip((f.weight, f.move, f.first), grads, strict=True):
        for at in [np.unravel_index(i, x.shape) for i in np.argsort(-np.abs(g), axis=None)[:6]]:
            old, eps = x[at], 1e-5
            x[at] = old + eps
            up = f.likelihood(lists_, ids, start, gold)[0]
            x[at] = old - eps
            down = f.likelihood(lists_, ids, start, gold)[0]
            x[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-4


def test_foreign_scripts_are_other(spark):
    b = build(spark, [{"uid": "r", "text": "слово за словом идёт рассказ о старом доме " * 5, "source": "book"}, {"uid": "e", "text": "the people of the town had been in the house with our own words " * 3, "source": "book"}])
    often = furniture.frequent_lines(furniture.line_sequences(b))
    got = {(r.uid, r.lang) for r in langid.segments(b, often, parts(spark), langid.train(b, often)).collect()}
    assert got == {("r", "other"), ("e", "english")}
    assert [tuple(r) for r in langid.found(b, often, parts(spark)).collect()] == [("e", "english")]


def test_languages_of_held_out_records(spark):
    """Trained on one half of the records, the field finds the language of the other half's: labels that a record's own
    words clearly contradict (they are wrong in part) aside, at least nine in ten."""
    b = table(spark, "/root/testdata/sf0.01", "build")
    often = furniture.frequent_lines(furniture.line_sequences(b))
    half = F.xxhash64("uid") % 2 == 0
    field = langid.train(b.where(half), often, 300)
    seg = langid.segments(b.where(~half), often, table(spark, "/root/testdata/sf0.01", "name_parts"), field).where("n_words >= 20").groupBy("uid").agg(F.collect_set("lang").alias("l"))
    x = seg.join(langid.labels(b), "uid").where("size(l) = 1 and label is not null and label <> 'mixed'")
    text_of = {r.uid: r.text for r in b.select("uid", "text").where("text is not null").collect()}
    right = n = 0
    for r in x.collect():
        hits = Counter(i for w in text.folded_words(text_of[r.uid]) for i in langid.LEXICON.get(w, ()) if len(langid.LEXICON[w]) == 1)
        clear = hits and hits.most_common(1)[0][1] > 0.7 * sum(hits.values())
        if r.label not in langid.LANGUAGES or clear and langid.LANGUAGES[hits.most_common(1)[0][0]] != r.label:
            continue
        n, right = n + 1, right + (r.label == r.l[0])
    assert n > 200 and right / n >= 0.9, (n, right)


# --- p8 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_item_once(seed):
    rng = np.random.default_rng(seed)
    x = np.minimum(rng.lognormal(5, 1, 500).astype(int) + 1, 1000)
    sizes, counts = np.unique(x, return_counts=True)
    used = Counter()
    boxes = 0
    for p, n in packing.plan(sizes, counts, 1000):
        assert sum(sizes[j] for j in p) <= 1000 and n > 0
        boxes += n
        for j in p:
            used[j] += n
    assert [used[j] for j in range(len(sizes))] == counts.tolist()
    assert boxes <= 1.02 * -(-int(x.sum()) // 1000) + 1


def test_packing_keeps_documents_whole(spark):
    rng = random.Random(10)
    d = spark.createDataFrame([(i, "x" * rng.randrange(1, 400)) for i in range(300)], "doc_id bigint, text string")
    rows = packing.pack_all(d, spark.createDataFrame([(1, 256), (2, 700)], "container_id int, capacity_tokens bigint")).where("capacity_tokens = 256").collect()
    load = Counter()
    for r in rows:
        size = r.tokens if r.tokens <= 256 else r.tokens % 256
        if r.container is not None:
            load[r.container] += size
        assert r.pieces == -(-r.tokens // 256)
    assert max(load.values()) <= 256 and len({r.doc_id for r in rows}) == 300 == len(rows)


# --- p9 ----------------------------------------------------------------------------------------------------------


def test_search_against_all_windows():
    rng = np.random.default_rng(11)
    word = lambda n: text.mix(rng.integers(0, 12, n).astype(np.uint64))
    items = [(i, word(rng.integers(3, 30))) for i in range(12)]
    docs = [word(rng.integers(0, 60)) for _ in range(60)]
    for i in range(20):
        h = items[i % 12][1]
        a = rng.integers(0, max(1, len(h) - 5))
        docs.append(np.concatenate([word(7), h[a : a + int(rng.integers(4, 9))], word(5)]))
    start = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    for run in (5, 14):
        d, i = leaks.WuManber(items, run).search(np.concatenate(docs), start)
        got = set(zip(d.tolist(), i.tolist(), strict=True))
        grams = lambda h: {tuple(h[k : k + run].tolist()) for k in range(len(h) - run + 1)}
        assert got == {(a, b) for a, x in enumerate(docs) for b, h in items if grams(x) & grams(h)}


# --- p10 ---------------------------------------------------------------------------------------------------------


def test_squeeze_undoes_disguises():
    g, at = abuse.squeeze(*text.codes(pa.array(["v e r m i n go", "veeermin  w0rthl3ss", "", "a b"])))
    s = g.tobytes().decode("utf-32-le")
    assert [s[a:b] for a, b in itertools.pairwise(at.tolist())] == [" vermin go ", " vermin worthless ", " ", " ab "]


def test_windows_against_plain_sums():
    g, at = abuse.squeeze(*text.codes(pa.array(["some words here " * 9, "short", ""])))
    ids = abuse.grams(g, at)
    w = np.random.default_rng(1).normal(size=1 << abuse.BITS)
    w[0] = 0
    top, where = abuse.worst(w, ids, at)
    for i, (a, b) in enumerate(itertools.pairwise(at.tolist())):
        sums = [sum(w[x[j]] for x in ids for j in range(p, min(p + abuse.WINDOW, b))) for p in range(a, b)]
        assert np.isclose(top[i], max(sums)) and np.isclose(sums[where[i] - a], top[i])


def test_held_out_accuracy():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    bad = ["you are all filthy vermin", "get out you worthless scum", "they are worse than beasts"]
    fine = ["a rat was seen near the mill", "calling anyone scum is wrong"]

    def make(n):
        texts, y = [], []
        for i in range(n):
            w = [rng.choice(vocab) for _ in range(60)]
            if i % 5 == 0:
                w.insert(rng.randrange(60), rng.choice(bad))
            elif i % 5 == 1:
                w.insert(rng.randrange(60), rng.choice(fine))
            texts.append(" ".join(w))
            y.append(i % 5 == 0)
        return texts, np.array(y)

    texts, y = make(600)
    noisy = y ^ (np.random.default_rng(2).random(600) < 0.03)
    w, b = abuse.fit(texts, noisy, ["vermin"])
    held, truth = make(300)
    g, at = abuse.squeeze(*text.codes(pa.array(held)))
    got = abuse.worst(w, abuse.grams(g, at), at)[0] + b > 0
    assert (got & truth).sum() / truth.sum() >= 0.95 and (got & truth).sum() / max(1, got.sum()) >= 0.9


# --- queries -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    if name in ORACLES:
        con = duckdb.connect()
        from pathlib import Path

        for p in Path(folder).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        res = con.execute(ORACLES[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(str(r[c]) for c in names) for r in rows) == Counter(tuple(map(str, r)) for r in res.fetchall())
    elif name.endswith("_found"):
        assert len(rows) == len(set(rows))


COLUMNS = {
    "p1_found": ["uid"], "p2_found": ["uid", "line_no"], "p3_found": ["key_a", "key_b"], "p4_found": ["uid_a", "uid_b"], "p5_found": ["uid", "kind", "start_at"],
    "p6_found": ["uid", "line_no", "kind"], "p7_found": ["uid", "lang"], "p8_found": ["capacity_tokens", "doc_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


def test_found_columns(spark, folder):
    assert all(sorted(QUERIES[n](spark, folder).columns) == sorted(c) for n, c in COLUMNS.items())


def test_pq_is_readable(folder):
    assert pq.read_table(f"{folder}/containers.parquet").num_rows == 2
