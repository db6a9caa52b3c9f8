"""The preprocessing chain, name and filter operators against plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexspark.functions import strings as S
from lexspark.functions import text as T
from lexspark.operators import chunks, feedback, filters, names, preprocess


def each(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_null_and_empty_texts(spark):
    for fn in preprocess.STAGES.values():
        assert each(spark, fn, [None, "", "plain"]) == [None, "", "plain"], fn


def test_title_pages(spark):
    title = "SUPREME COURT\nIndex No. 5\nDEPOSITION OF X\n"
    body = "Q. What happened?\nA. Nothing.\n" * 30
    big = "SUPREME COURT Index No. 5 " + "word " * 2000
    got = each(spark, preprocess.without_title_pages, [title + "\f" + body, body + "\f" + title, title + "\f" + title, title, title + "\n\n\n\n\n" + body, big + "\f" + "tail " * 300])
    assert got == [body, body + "\n\n" + title, title, title, body, big + "\n\n" + "tail " * 300]


def test_index_pages(spark):
    index = "\n".join(f"word ({i}) 12:{i}" for i in range(10, 40))
    text = "\n".join(f"line {i} of the text" for i in range(120))
    got = each(spark, preprocess.without_index_pages, [text + "\f" + index + "\fend", index + "\f" + text, text, text + "\n" + index + "\n" + index, "x " * 400 + " ".join(f"morning ({i}) 33:12" for i in range(400))])
    assert got[0] == text and got[1] == index + "\f" + text and got[2] == text
    assert text.startswith(got[3]) and len(got[3].split("\n")) >= 95
    assert got[4].startswith("x x") and "morning (399)" not in got[4] and len(got[4]) < 3000


def test_headers(spark):
    text = "Smith v Jones Case No. 5 page 1\nbody\nSmith v Jones Case No. 5 page 2\nmore\nSmith v Jones Case No. 5 page 33\nsaid\nsaid\nsaid\nDIRECT - SMITH\nDIRECT - SMITH\nDIRECT - SMITH\nACME memo\nACME memo\nACME memo"
    assert each(spark, preprocess.without_headers, [text]) == ["body\nmore\nsaid\nsaid\nsaid\nACME memo\nACME memo\nACME memo"]
    assert each(spark, lambda t: preprocess.without_headers(t, custom=["acme"], short_lines=False), [text]) == ["body\nmore\nsaid\nsaid\nsaid\nDIRECT - SMITH\nDIRECT - SMITH\nDIRECT - SMITH"]
    assert each(spark, preprocess.without_headers, ["page 1\npage 1\nx"]) == ["page 1\npage 1\nx"]


def test_line_numbers_and_citations_like_python(spark):
    r = random.Random(3)
    words = ["Q", "A", "the", "Smith.", "met", "12", "5", "25", "30", "boxes", "told", "(5)", "959:14;1003:24", "Antonio", "59:12;60:21", "said?", "August", "café"]
    texts = ["\n".join("".join(r.choice([" ", "  ", "   "]) + r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(6)) for _ in range(60)]

    def python(t, rules):
        for pattern, new in rules:
            flags = "".join(f for f in re.match(r"(?:\(\?([a-zU]+)\))?", pattern)[1] or "" if f in "im")
            body = re.sub(r"^\(\?[a-zU]+\)", "", pattern)
            t = re.sub(f"(?{flags}){body}" if flags else body, new.replace("$", "\\"), t)
        return t

    assert each(spark, T.without_line_numbers, texts) == [python(t, T.LINE_NUMBERS) for t in texts]
    assert each(spark, preprocess.without_citations, texts) == [python(t, [(p, "$1") for p in preprocess.CITATIONS]) for t in texts]


def test_page_boundaries():
    body = "the witness said a good deal about what had happened on that day in the street "
    text = body + "sn 29 Proceedings 3 " + body + "jk 30 Cross examination " + body + "31 MR. SMITH: yes " + body
    got = preprocess.page_boundaries(text)
    assert got == body + "  " + body + "  " + body + "  MR. SMITH: yes " + body
    runs = "start 1 2 3 4 5 6 7 8 middle 1 2 3 4 5 6 7 8 end 1 2 3 4 too short"
    assert preprocess.page_boundaries(runs) == "start  middle  end 1 2 3 4 too short"
    assert preprocess.page_boundaries("counts 5 and 6 and 7 are near") == "counts 5 and 6 and 7 are near"


def brute_chain(text):
    found = [(m.start(), int(m[0])) for m in re.finditer(r"(?<!\d)\d{1,4}(?!\d)", text) if 2 <= int(m[0]) <= 5000]
    best = []
    for i, (p, n) in enumerate(found):
        chain, want = [p], n + 1
        for q, m in found[i + 1 :]:
            if m == want:
                chain.append(q)
                want += 1
        if len(chain) > len(best):
            best = chain
    ok = len(best) >= 3 and (best[-1] - best[0]) / (len(best) - 1) >= 50
    return best if ok else []


def test_page_number_chains_against_brute_force():
    r = random.Random(8)
    for _ in range(200):
        text = "".join("w" * r.randint(1, 60) + f" {r.randint(2, 12)} " for _ in range(r.randint(0, 30)))
        assert [a for a, _ in preprocess.page_numbers(text)] == brute_chain(text)


def test_standalone_numbers(spark):
    got = each(spark, preprocess.without_standalone_numbers, ["a\n4\nb\n5\nc\n 7 \nd", "a\n4\nb\n4\nc\n5\nd\n6", "a\n9\nb\n5\nc\n6", "a\n1\nb\n9\nc\n20"])
    assert got == ["a\nb\nc\nd", "a\n4\nb\n4\nc\n5\nd\n6", "a\n9\nb\n5\nc\n6", "a\n1\nb\n9\nc\n20"]


def test_whole_chain(spark):
    d = spark.createDataFrame([(1, "CONFIDENTIAL\n1  Q  Hello there\nCONFIDENTIAL\n2  A  Yes\nCONFIDENTIAL\nlast"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in preprocess.preprocessed(d, stats="removed").collect()}
    assert out[1].text == "Q Hello there\nA Yes\nlast" and out[1].removed["headers_footers"] == 39 and out[2].text is None
    assert preprocess.default_stages() == ["index_pages", "headers_footers", "line_numbers", "page_boundaries", "transcript_artifacts"]
    assert preprocess.default_stages({"title_page_handling": "exclude_all", "preprocess_line_numbers": False})[:2] == ["title_pages", "index_pages"]
    with pytest.raises(ValueError):
        preprocess.preprocessed(d, stages=["nothing"])


def test_name_forms(spark):
    raw = ["DI LEO 1 Q", "SMITH: Objection", "Di Leo 17", "2 MS Brown", "Smith's", "o'brien-jones", "JONES MR", "17"]
    assert each(spark, lambda x: S.name_form(S.without_artifacts(x)), raw) == ["Di Leo", "Smith", "Di Leo", "Brown", "Smith", "O'Brien-Jones", "Jones", "17"]
    got = each(spark, S.title_split, ["Dr. Jones", "judge Ann Lee", "Drake Bell", "Mr Smith", "Mr. ", "hon. X"])
    assert [tuple(x) for x in got] == [("Jones", "dr."), ("Ann Lee", "judge"), ("Drake Bell", ""), ("Smith", "mr."), ("Mr.", ""), ("X", "hon.")]
    assert each(spark, S.has_ocr_signs, ["Jenkins", "Srnith", "J0hn", "Wi1son", "ABC123", "ab"]) == [False, True, True, True, True, False]


def test_similar_pairs_against_brute_force(spark):
    r = random.Random(4)
    first, last = ["jon", "john", "joan", "mary", "marie", "jeremy"], ["smithson", "smithsen", "mcculloch", "mccullough", "li", "lee", "jonson"]
    people = {f"{r.choice(first)} {r.choice(last)}" for _ in range(30)} | {"".join(r.choices("abc", k=r.randint(3, 9))) for _ in range(60)} | {"Jon Smithson", "arthur jenkins", "anhur jenkins", "bates", "batse"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
        return row[-1]

    def alike(a, b):
        if a[0] != b[0]:
            return False
        x, y = sorted(set(a.split()) - set(b.split())), sorted(set(b.split()) - set(a.split()))
        shares = len(a.split()) > 1 and len(b.split()) > 1 and set(a.split()) & set(b.split()) and x and len(x) == len(y)
        like = lambda u, v, t: SequenceMatcher(None, u, v).ratio() >= t
        return like(a, b, 0.85) or (shares and all(like(u, v, 0.75) for u, v in zip(x, y))) or (min(len(a), len(b)) >= 8 and distance(a, b) <= 2)

    order = sorted(people, key=lambda x: (x.lower(), x))
    want = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if alike(a.lower(), b.lower())}
    got = {tuple(x) for x in names.similar_pairs(spark.createDataFrame([(p,) for p in people], "term string")).select("a", "b").collect()}
    assert got == want and ("john smithson", "jon smithson") in got
    seeds = {x.term: x.seed for x in names.similar_names(spark.createDataFrame([("John Smithson", 9), ("Jon Smithson", 3), ("Kenny McCulloch", 5), ("Kenny McCullough", 6), ("Bates", 2), ("Gates", 2)], "term string, n long")).collect()}
    assert seeds == {"John Smithson": "John Smithson", "Jon Smithson": "John Smithson", "Kenny McCulloch": "Kenny McCullough", "Kenny McCullough": "Kenny McCullough", "Bates": "Bates", "Gates": "Gates"}


def test_titles_and_roles(spark):
    people = spark.createDataFrame([("James Jones", 5), ("Patricia Jones", 3), ("Mr. Jones", 2), ("Dr. Patricia Jones", 1), ("Ann Lee", 4), ("Judge Lee", 2), ("Ms. Lee", 1), ("Dr. Who", 1)], "term string, n long")
    got = {r.term: r.target for r in names.titles_resolved(people).collect()}
    assert got == {"Mr. Jones": None, "Dr. Patricia Jones": "Patricia Jones", "Judge Lee": "Ann Lee", "Ms. Lee": "Ann Lee", "Dr. Who": None}
    assert {tuple(r) for r in names.with_titles(people).collect()} == {("James Jones", 5), ("Patricia Jones (Dr.)", 4), ("Mr. Jones", 2), ("Ann Lee (Judge.)", 7), ("Dr. Who", 1)}
    texts = spark.createDataFrame([("The defendant attorney Mary Jones. Then plaintiff John Smith; Ann Bell testified. He works at Acme Corp daily.",)], "text string")
    who = spark.createDataFrame([("Mary Jones",), ("John Smith",), ("Ann Bell",), ("Dr. Else",), ("Nobody",)], "person string")
    assert {r.person: r.role for r in names.roles(who, texts).collect()} == {"Mary Jones": "Defendant attorney", "John Smith": "Plaintiff", "Ann Bell": "Witness", "Dr. Else": "Medical professional", "Nobody": "Person in case"}
    where = spark.createDataFrame([("Acme Corp",), ("Elsewhere",)], "place string")
    assert {r.place: r.role for r in names.places(where, texts).collect()} == {"Acme Corp": "Workplace", "Elsewhere": "Location mentioned in case"}


def test_filters(spark):
    v = spark.createDataFrame([("Luigi Napolitano", 50, True), ("Luigi Napontano Patient", 2, True), ("Napolitano-Direct", 1, True), ("Luigi", 3, True), ("direct examination", 4, False), ("Ann Bell", 9, True), ("Ann Bell Luigi Napolitano", 1, False), ("knee surgery", 5, False), ("xqzkw", 2, False), ("Qwxz Zzkjx", 1, True)], "term string, n long, is_person boolean")
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "term string")
    left = lambda df: {r.term for r in df.collect()}
    every = left(v)
    assert every - left(filters.without_header_terms(v)) == {"direct examination", "Ann Bell Luigi Napolitano"}
    assert every - left(filters.without_components(v)) == {"Luigi"}
    assert every - left(filters.without_name_headers(v, words("patient"))) == {"Napolitano-Direct"}
    assert every - left(filters.without_common_variants(v, words("patient"))) == {"Luigi Napontano Patient"}
    known = words("knee", "surgery", "direct", "examination", "bell", "luigi", "napolitano", "patient")
    assert every - left(filters.without_gibberish(v, known)) == {"xqzkw"}
    assert every - left(filters.without_unknown_people(v, known)) == {"Qwxz Zzkjx", "Napolitano-Direct"}
    out, skipped = filters.chain(v, [filters.Filter("broken", 1, lambda d: d.select("nothing")), filters.Filter("off", 2, lambda d: d.limit(0), enabled=False), filters.Filter("parts", 3, filters.without_components)])
    assert left(out) == every - {"Luigi"} and set(skipped) == {"broken"}
    typos = spark.createDataFrame([("jenkins", 40, True), ("jenidns", 8, True), ("other", 5, False)], "term string, n long, is_person boolean")
    assert left(filters.without_typos(typos, words("jenkins"))) == {"jenkins", "other"}
    assert left(filters.without_typos(typos, words("jenidns"))) == {"jenidns", "other"}


def test_pieces(spark):
    text = "One two three. Four five six! Seven eight nine? Ten eleven twelve."
    assert [text[s["start"] : s["end"]] for s in each(spark, S.sentences_with_ends, [text])[0]] == ["One two three.", "Four five six!", "Seven eight nine?", "Ten eleven twelve."]
    assert each(spark, lambda t: S.cut_at_sentence(t, 32), [text, "short", "x" * 50]) == ["One two three. Four five six!...", "short", "x" * 32 + "..."]
    assert each(spark, lambda t: chunks.excerpt(t, F.lit(20), F.lit(24)), [text]) == ["...Four five six!..."]
    long = "alpha beta gamma. " * 60 + "\n\n" + "z" * 700
    pieces = chunks.split_text(long)
    assert all(len(p) <= 500 for p in pieces) and "".join(pieces).count("z") >= 700
    assert chunks.split_text("a b") == ["a b"]
    assert each(spark, lambda t: chunks.paragraph_chunks(t, 12), ["aaaa\n\nbbbb\n\ncccccccccccccccc\n\nd"]) == [["aaaa\n\nbbbb", "cccccccccccccccc", "d"]]


def test_ensemble_needs_rows_of_each_class(spark):
    d = spark.createDataFrame([(i, "Word " * (i % 7 + 1) + ("#$% " * 5 if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = lambda n, rare: spark.createDataFrame([(i, 0 if (i % 2 if not rare else i < 2) else 1) for i in range(n)], "doc_id long, quality int")
    assert feedback.train_ensemble(d, labels(20, False)) is None and feedback.train_ensemble(d, labels(60, True)) is None
    models = feedback.train_ensemble(d, labels(35, False))
    assert models[1] is None
    keep = {r.doc_id: r.keep for r in feedback.predict_ensemble(feedback.train_ensemble(d, labels(60, False)), d).collect()}
    assert all((keep[i] > 0.5) == (i % 2 == 0) for i in keep)
