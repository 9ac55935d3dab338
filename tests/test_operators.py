"""Core operators against brute force and on hand-made rows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import folds
from millrace.operators.graph import components
from millrace.operators.minhash import near_duplicates
from millrace.operators.tokenizing import byte_spans, default_path, encoded, merge_ranks, ranks, viterbi
from millrace.sources import readers, sinks


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    e = spark.createDataFrame([*edges, (None, 3)], "a int, b int")
    got = {r.node: r.component for r in components(e, spark.range(60).select(F.col("id").cast("int").alias("node"))).collect()}
    assert got == {i: root(i) for i in range(60)}


def test_components_of_a_chain_and_of_nothing(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "a int, b int")
    assert {r.component for r in components(e, spark.createDataFrame([(i,) for i in range(21)], "node int")).collect()} == {0}
    none = spark.createDataFrame([], "a int, b int")
    assert components(none, spark.createDataFrame([], "node int")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    docs = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(docs)]
    for i, t in enumerate(docs[:5]):
        w = t.split()
        w[7] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, docs[0]), (201, docs[1].replace(" ", "  ")), (300, ""), (301, None)]
    got = {r.ord: r for r in near_duplicates(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}

    def grams(t):
        x = "".join(t.split())
        return {x[i : i + 5] for i in range(len(x) - 4)}

    for i in range(5):
        a, b = grams(docs[i]), grams(dict(rows)[100 + i])
        sim = len(a & b) / len(a | b)
        assert got[100 + i].similarity == pytest.approx(sim, abs=1e-4)
        assert (got[100 + i].status == "near_duplicate") == (sim >= 0.85)
        assert got[100 + i].duplicate_of == (i if sim >= 0.85 else None)
    assert got[200].status == got[201].status == "exact_duplicate" and got[200].duplicate_of == 0
    assert got[300].status == "unique" and got[301].duplicate_of == 300
    assert len(got) == len(rows)


def test_folds(spark):
    df = spark.createDataFrame([([4, 9, 3, 2, 1],), ([],), ([20],)], "s array<bigint>")
    taken = [r[0] for r in df.select(folds.budget_with_skip(F.col("s"), 10)).collect()]
    assert taken == [[True, False, True, True, True], [], [False]]
    units = [r[0] for r in df.select(folds.pack_units(F.col("s"), 10)).collect()]
    assert units == [[19], [], [20]]
    assert [r[0] for r in spark.createDataFrame([([3, 3],)], "s array<bigint>").select(folds.pack_units(F.col("s"), 10)).collect()] == [[6]]


def test_segmentation(spark):
    text = "A title\nFirst sentence.\nSecond sentence.\nNext title\nBody."
    rows = folds.segment(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.article, r.title, r.n_lines) for r in rows] == [(1, 0, "A title", 2), (1, 1, "Next title", 1)]


@pytest.mark.parametrize("bad", [None, "", " \n\t"])
def test_text_functions_on_empty(spark, bad):
    r = spark.createDataFrame([(bad,)], "c string").select(T.script_fraction(F.col("c")), T.word_count(F.col("c")), F.size(T.char_shingles(F.col("c"))), T.clean_text(F.col("c")), F.size(T.ngrams(T.leak_words(F.col("c")), 3))).first()
    assert r[0] in (None, 0.0) and r[1] in (None, -1, 0) and r[2] in (None, -1, 0)


def test_merge_ranks_agrees_with_library():
    tiktoken = pytest.importorskip("tiktoken")
    table = ranks(default_path("byte_bpe_50k.tiktoken"))
    import public_tokenizers

    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    for w in ("hello", "tokenization", "شہر", "aaaaaaaaaaaaaaaaa", "x"):
        assert merge_ranks(w.encode(), table) == e.encode_single_piece(w) if hasattr(e, "encode_single_piece") else e.encode_ordinary(w)


def test_viterbi_against_all_splits():
    scores = {"a": -3.0, "b": -3.0, "ab": -4.0, "ba": -3.5, "aba": -5.0}

    def splits(t):
        if not t:
            yield []
        for i in range(1, len(t) + 1):
            if t[:i] in scores:
                for r in splits(t[i:]):
                    yield [t[:i], *r]

    for t in ("abab", "ababa", "bbaab"):
        got = viterbi(t, scores)
        assert "".join(got) == t
        assert sum(scores[p] for p in got) == max(sum(scores[p] for p in x) for x in splits(t))
    assert viterbi("", scores) == [] and viterbi("z", scores) == ["z"]
    assert byte_spans([b"ab", b"c"]) == [(0, 2), (2, 3)] and byte_spans([]) == []


def test_encoding_handles_nulls(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.ids for r in encoded(df, "k", "t", "byte_bpe").collect()}
    assert len(got[1]) == 2 and got[2] is None and got[3] == []


PAGE = "<html><head><title>T &amp; t</title><style>x{}</style></head><body><nav>menu</nav><div id='main-content'><p>One<br>two</p><script>1</script><p>three</p></div><footer>end</footer></body></html>"


def test_html(spark):
    assert readers.page_text(PAGE) == ("T & t", "One\ntwo\nthree")
    assert readers.page_text("<p>a</p><div>b <b>c</b></div>") == ("", "a\nb c")
    assert readers.page_text(None) == ("", "") and readers.page_text("<<<>") is not None
    rows = readers.html_text(spark.createDataFrame([(1, PAGE), (2, None)], "k int, h string"), "k", "h").collect()
    assert [(r.k, r.text) for r in rows] == [(1, "One\ntwo\nthree"), (2, "")]


def test_files(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(z.getvalue())
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.txt").write_bytes("شہر".encode())
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.binary_files(spark, str(tmp_path)).collect()}
    assert kinds == {"a.docx": "docx", "b.bin": "pdf", "c.txt": "text"}
    few = spark.createDataFrame([(bytearray(),), (None,), (bytearray(b"\xff\xfe\x00"),)], "content binary")
    assert [r[0] for r in few.select(readers.file_kind(F.col("content"))).collect()] == ["empty", "empty", "unknown"]
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in readers.docx_files(spark, str(tmp_path)).collect()}
    assert texts["a.docx"] == "one\ttwo\n" and texts["b.bin"] is None
    assert readers.repair_mojibake("شہر".encode().decode("latin-1")) == "شہر" and readers.repair_mojibake("é") == "é"


def test_json_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "شہر\n\n b", "strict"), (2, None, "reject")], "id int, text string, tier string")
    sinks.json_lines(df, f"{tmp_path}/j")
    back = readers.json_lines(spark, f"{tmp_path}/j", "id int, text string, tier string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnot json\n')
    assert readers.json_lines(spark, f"{tmp_path}/bad.jsonl", "id int", "drop").count() == 1
    assert readers.json_lines(spark, f"{tmp_path}/bad.jsonl", "id int", "keep").cache().where("_corrupt_record is not null").count() == 1
    sinks.line_view(df, f"{tmp_path}/l", "text")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l").collect()) == [" b", "شہر"]
    sinks.rejected(df.withColumn("reasons", F.lit("x")), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/index").columns == ["id", "tier", "reasons"]
    with pytest.raises(FileNotFoundError):
        sinks.promote(spark, f"{tmp_path}/r", f"{tmp_path}/out", ["index", "missing"])
    sinks.promote(spark, f"{tmp_path}/r", f"{tmp_path}/out", ["index", "bodies"])
    assert spark.read.parquet(f"{tmp_path}/out/bodies").count() == 1
    sinks.json_lines(df, f"{tmp_path}/again")
    with pytest.raises(FileExistsError):
        sinks.promote(spark, f"{tmp_path}/again", f"{tmp_path}/out", [])
    (tmp_path / "t.txt").write_text("# a\nx\n# b\ny\n")
    assert [r.text for r in readers.text_units(spark, f"{tmp_path}/t.txt", "sections", "# ").orderBy("unit").collect()] == ["# a\nx\n", "# b\ny\n"]
    assert readers.text_units(spark, f"{tmp_path}/t.txt", "lines").count() == 4
    (tmp_path / "g.tsv").write_text("w\tn\na\t1\n\t2\n")
    with pytest.raises(Exception, match="invalid row"):
        readers.delimited(spark, f"{tmp_path}/g.tsv", "w string, n int", F.col("w").isNotNull()).collect()
    seen, links = spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string")
    assert [r.url for r in readers.frontier(seen, links).collect()] == ["b"]


def test_incremental_ingestion(spark, tmp_path):
    from millrace.streaming.ingest import ingest, merge_new

    src, schema = tmp_path / "in", "k int, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(f"{src}/1")
    args = (spark, f"{src}/*", schema, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert ingest(*args) == 2
    assert ingest(*args) == 0
    spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], schema).write.parquet(f"{src}/2")
    assert ingest(*args) == 3
    m = (spark, f"{src}/*", schema, f"{tmp_path}/m", f"{tmp_path}/mck", "k")
    merge_new(*m)
    spark.createDataFrame([(3, "z"), (4, "f")], schema).write.parquet(f"{src}/3")
    merge_new(*m)
    got = sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/m").collect())
    assert [k for k, _ in got] == [1, 2, 3, 4]
