import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import chunks, feedback, merge, names, search, terms
from lexspark.sources import readers, sinks
from lexspark.streaming import cumulative


def value(spark, fn, text):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("x")).first().x


def test_cleaning(spark):
    assert value(spark, T.dehyphenated, "exam-\n  ple text") == "example text"
    assert value(spark, T.without_page_numbers, "a\nPage 3 of 9\n- 4 -\n12\nb 12") == "a\nb 12"
    assert value(spark, T.collapsed, "  a\n \n\n\nb ") == "a\n\nb"
    assert value(spark, T.lowered_capitals, "SOME LOUD LINE\nSUPREME COURT\nab") == "some loud line\nSUPREME COURT\nab"
    assert value(spark, T.redacted, "x ██▓ y █") == "x  [REDACTED]  y █"
    assert value(spark, T.without_controls, "a\x07b\fc\u200bd") == "a b\ncd"
    assert value(spark, T.case_numbers, "Case No. 1:23-cv-12345; Index No. 123456/2024; Case No. 1:23-cv-12345") == ["Case No. 1:23-cv-12345", "Index No. 123456/2024", "Case No. 1"]
    assert value(spark, T.speaker_boundaries, "MR. SMITH: hi\nTHE COURT: yes") == "\n\nMR. SMITH: hi\n\n\nTHE COURT: yes"
    assert value(spark, T.sentences, "One. Two! Three") == ["One.", "Two!", "Three"]
    assert value(spark, T.tokens, "The plaintiff's X-ray, 3D of it") == ["plaintiff's", "x-ray"]
    assert value(spark, T.merge_key, " Smith's ") == "smith"
    assert value(spark, T.html_text, "<p>a&amp;b<script>x</script><!-- c --> d</p>") == "a&b d"
    assert value(spark, T.latin1, "café Ł ā") == "café ? a"
    assert value(spark, T.nfkc, "ﬁ") == "fi"


def test_typo_pairs_against_brute_force(spark):
    r = random.Random(3)
    words = {}
    for _ in range(60):
        w = "".join(r.choices("abcd", k=r.choice([5, 6, 9, 21, 23, 24, 26, 30])))
        words[w] = 100
        for _ in range(3):
            x = list(w)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], ["e"], [x[k], "f"]])
            words.setdefault("".join(x), 2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
        return row[-1]

    want = {(a, b) for a, n in words.items() for b, m in words.items() if n * 10 <= m and min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    got = names.typo_pairs(spark.createDataFrame(list(words.items()), "term string, n long")).collect()
    assert {(x.term, x.canonical) for x in got} == want and len(got) == len(want)


def test_names(spark):
    t = spark.createDataFrame([("John Smith", 9), ("Smith John", 2), ("John", 3), ("Jane Doe", 4), ("Ann Smith", 1), ("John Adam Smith", 1)], "term string, n long")
    assert {(r.name_key, r.term, r.n_forms) for r in names.reversed_names(t).collect()} >= {("john smith", "John Smith", 2)}
    assert {r.term for r in names.fragments(t).collect()} == {"John", "John Smith", "Smith John"}
    assert [tuple(r) for r in names.shared_last_names(t).collect()] == [("smith", 2)]
    assert {r.term for r in names.component_names(t).collect()} == {x for x in ("John Smith", "Smith John", "Jane Doe", "Ann Smith", "John Adam Smith")}
    g = {r.term: r.seed for r in names.similar_names(spark.createDataFrame([("Jon Smyth", 1), ("Jon Smith", 5), ("Joe Brown", 2)], "term string, n long")).collect()}
    assert g == {"Jon Smith": "Jon Smith", "Jon Smyth": "Jon Smith", "Joe Brown": "Joe Brown"}


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} has exactly seven words." for i in range(200))
    out = chunks.packed(text, 225, 325, 125, 35)
    assert all(n <= 325 for _, n in out) and all(n >= 125 for _, n in out)
    for (a, _), (b, _) in zip(out, out[1:]):
        assert b.split(". ")[0] in a  # overlap
    rows = chunks.chunk(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [r.chunk_num for r in rows] == list(range(1, len(out) + 1)) and {r.doc_id for r in rows} == {1}
    s = chunks.snippets(spark.createDataFrame([(1, "Aa bb AA cc")], "doc_id long, text string"), spark.createDataFrame([("aa",)], "term string"), around=3).collect()
    assert sorted((r.pos, r.hit, r.before, r.after, r.n_hits) for r in s) == [(0, "Aa", "", " bb", 2), (6, "AA", "bb ", " cc", 2)]


def test_search(spark):
    v = spark.createDataFrame([(i, [float(i == k) for k in range(3)], i % 2) for i in range(3)] + [(3, [0.9, 0.1, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    n = search.nearest(v, v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), top=2).collect()
    assert [(r.vec_id, r.rank) for r in sorted(n, key=lambda r: r.rank)] == [(0, 1), (3, 2)]
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 20, 1)], "query_id int, doc_id int, rank int")
    assert search.fused([(a, 1.0), (b, 0.9)], "doc_id").orderBy("rank").first().doc_id == 20


def test_scores(spark):
    one = spark.range(1)
    q = lambda term, count, algos: one.select(terms.quality_score(F.lit(False), F.lit(count), F.lit(0), F.lit(algos), F.lit(term), F.lit(1), F.lit(1), F.lit(0.9), F.lit(0.0), F.lit(False), F.lit(0.0)).alias("s")).first().s
    assert q("term", 9, 1) == 88.0 and q("term", 9, 2) == 92.0 and q("TERM", 9, 1) == 76.0 and q("9x", 9, 1) == 80.0
    m = lambda x: one.select(terms.adjusted_mean(F.array(*map(F.lit, x)) if x else F.array().cast("array<double>"), 0.1).alias("m")).first().m
    assert m([0.75, 0.00003, 0.05]) == 0.75 and m([0.01, 0.02, 0.03]) == pytest.approx(0.02) and m([]) == 0
    r = feedback.last_wins(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, ts int, v string"), ["k"], ["ts"]).first()
    assert r.v == "y"
    c = spark.createDataFrame([("Heart", "NER", 0.9, "Medical", 2), ("heart", "RAKE", 0.5, "Technical", 1)], "term string, algorithm string, confidence double, type string, frequency long")
    x = merge.merged(c, {"NER": 1.0, "RAKE": 0.7}).first()
    assert (x.key, x.term, x.frequency, x.n_algorithms, x.type) == ("heart", "Heart", 3, 2, "Medical")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello World")
    (tmp_path / "b.rtf").write_bytes(rb"{\rtf1{\fonttbl x;}Caf\'e9\par two}")
    (tmp_path / "c.bin").write_bytes(b"x")
    df = spark.createDataFrame([("a<b", 1)], "term string, n int")
    (tmp_path / "d.docx").write_bytes(sinks.docx_report(df, "Title"))
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "Hello World" and got["a.txt"].method == "direct_read"
    assert got["b.rtf"].text == "Café\ntwo" and got["d.docx"].text == "Title\nterm | n\na<b | 1"
    assert got["c.bin"].status == got["e.docx"].status == "error"
    assert "<td>a&lt;b</td>" in sinks.html_page(df, "T") and "a<b | 1" in sinks.text_report(df, "T")
    assert zipfile.is_zipfile(io.BytesIO(sinks.docx_report(df, "T")))
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).collect()[0].term == "a<b"


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta alpha")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    cumulative.cumulative_terms(docs, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, "alpha gamma")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    cumulative.cumulative_terms(docs, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in cumulative.term_totals(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {("alpha", 2, 3), ("beta", 1, 1), ("gamma", 1, 1)}


def test_acronyms_of_all_texts(spark, tmp_path):
    import re

    from lexspark import catalog

    texts = ["FBI und CIA, §EU é NATO", "ÉTA ETAÉ A1 ABC1 _UN X ABCDEFG", "L'ONU à l'UE", "plain ASCII text", None, "", "中UN国 UN。"]
    rows = list(enumerate(texts)) + [(None, "WHO ß")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.term) for r in catalog.QUERIES["acronyms_all"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(k, m) for k, t in rows for m in re.findall(r"\b[A-Z]{2,6}\b", t or "")], key=str)
    assert (0, "NATO") in got and (None, "WHO") in got


@pytest.mark.parametrize("k", [3, 9])
def test_choose_k_finds_many_clusters(spark, k):
    from lexspark.operators import display

    r = random.Random(5)
    rows = [([(10.0 if j == i % k else 0.0) + r.gauss(0, 0.2) for j in range(9)],) for i in range(30 * k)]
    assert display.choose_k(spark.createDataFrame(rows, "embedding array<double>")) == k
