import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspark.llm import line_dedup, token_counts

FILE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, digest string, n_words int, t string"


def test_counts_equal_the_library(spark):
    texts = [None, "", " \n\t", "Hello, World's BEST <|endoftext|>x<|startoftext|> 1234", "é é    \x85\x1c nbsp here", "ΑΣ Σ.İ ǅ", "word " * 9000, "x" * 20_000, "퟿ 😀😀 \x00"]
    rows = [(i, t, "", 1, "") for i, t in enumerate(texts)] + [(None, "a b", "", 1, ""), (3, texts[3], "", 1, "")]
    tok = Tokenizer.from_file(FILE)
    for kw in ({}, {"frequent": 3, "cached": 2}):
        got = token_counts.count(spark.createDataFrame(rows, DOCS), FILE, **kw).collect()
        want = [(k, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for k, t, *_ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count(spark.createDataFrame([], DOCS), FILE).collect() == []


def test_refuses_tokens_across_white_space(spark):
    with pytest.raises(ValueError):
        token_counts.count(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"))


LONG = "The quick brown fox jumps over the lazy dog near the old river bank"


@pytest.mark.parametrize("paragraphs", [False, True])
def test_repeats_against_brute_force(spark, paragraphs):
    gap = "\n\n" if paragraphs else "\n"
    texts = [LONG + gap + "short line", "é𝒳 x" + gap + LONG.upper() + "!" + gap + LONG, None, "", gap + "  " + LONG.replace(" ", "   ") + gap, "own words that nobody else has in any text of this small set", LONG]
    rows = [(i, t, "", 1, "") for i, t in enumerate(texts)] + [(None, LONG, "", 1, ""), (6, LONG, "", 1, "")]
    df = spark.createDataFrame(rows, DOCS)
    seen, want = {}, set()
    for k, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        at = 0
        for unit in (t or "").split(gap):
            n = " ".join(unit.lower().split()).strip("!")
            if len(n.split()) >= 10:
                first = seen.setdefault(n, (k, at))
                if first != (k, at):
                    want.add((k, at, at + len(unit), *first))
            at += len(unit) + len(gap)
    got = {(r.doc_id, r.start, r.end, r.kept_doc, r.kept_start) for r in line_dedup.repeats(df, paragraphs=paragraphs).collect()}
    assert got == want
    assert line_dedup.repeats(df.limit(0)).collect() == []
    if not paragraphs:
        out = {r.doc_id: r.text for r in line_dedup.removed(df).collect()}
        assert out[0] == texts[0] and out[1] == "é𝒳 x\n" and out[6] == "" and out[2] is None and out[5] == texts[5]


def test_short_lines_and_wrapped_passages(spark):
    words = [f"word{i}" for i in range(60)]
    wrap = lambda n: "\n".join(" ".join(words[i : i + n]) for i in range(0, 60, n))
    texts = ["Menu\nAll rights reserved\n\n" + wrap(7), "all RIGHTS reserved.\nmenu\n***\n", wrap(9) + "\n\nown line", "own text\n\n" + " ".join(words), "---\nown\n---", None]
    df = spark.createDataFrame([(i, t, "", 1, "") for i, t in enumerate(texts)], DOCS)
    got = {(r.doc_id, r.start, r.end, r.kept_doc, r.kept_start) for r in line_dedup.repeats(df).collect()}
    assert got == {(1, 0, 20, 0, 5), (1, 21, 25, 0, 0), (2, 0, len(wrap(9)), 0, 26), (3, 10, len(texts[3]), 0, 26)}
    twice = spark.createDataFrame([(i, "a b\nc d\n\ne f", "", 1, "") for i in range(2)], DOCS)
    assert {r.doc_id: r.text for r in line_dedup.removed(twice).collect()} == {0: "a b\nc d\n\ne f", 1: "\n"}


def brute_passages(rows, least):
    """Units of runs, by plain loops: the lines, and the sentences of paragraphs, that occur elsewhere too."""
    import re

    levels, seen = {}, {}
    for k, t in rows:
        t = t or ""
        lines, sentences, at = [], [], 0
        for line in t.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        for p in re.split(r"(\n\s*\n)", t):
            begin = s = at = 0 if not sentences else sentences[-1][1]
            for m in re.finditer(r"[.!?]+\s+", p) if p.strip() else ():
                sentences.append((s, begin + m.end()))
                s = begin + m.end()
            sentences.append((s, begin + len(p)))
        for level, spans in enumerate((lines, sentences)):
            units = [(s, e, line_dedup.normalised(t[s:e])) for s, e in spans]
            levels[k, level] = [u for u in units if u[2]]
            for s, _, u in levels[k, level]:
                seen.setdefault(u, set()).add((10**9 if k is None else k, s))
    out = set()
    for (k, _), units in levels.items():
        run = []
        for s, e, u in [*units, (0, 0, None)]:
            if u and len(seen[u]) > 1:
                run.append((s, e, u))
                continue
            if sum(len(x.split()) for x in {x[2] for x in run}) > least:
                out |= {(k, a, b, min(seen[x]) != (10**9 if k is None else k, a)) for a, b, x in run}
            run = []
    return out


def test_passages_against_brute_force(spark):
    import random

    r = random.Random(5)
    words = lambda n: " ".join(r.choice("alpha beta gamma delta rho sigma tau phi").capitalize() + str(r.randint(0, 99)) for _ in range(n))
    passage = ". ".join(words(9) for _ in range(7)) + "."
    rows = [(0, words(20) + ". " + passage + " " + words(12)), (1, passage.replace(". ", ".\n")), (2, words(8) + "\n" + passage.upper() + "\n" + words(9)), (3, None), (4, "")]
    rows += [(5 + i, words(30) + ".\nAll rights reserved by us\n" + words(25) + ".") for i in range(4)]
    rows += [(9, "Same line again and again here\n" * 12), (10, words(3) + ". " + words(40)), (11, "x " * 30_000 + "\n\n" + passage), (None, "\n\n".join(passage.split(". ")))]
    df = spark.createDataFrame([(k, t, "", 1, "") for k, t in [*rows, rows[1]]], DOCS)
    got = {(x.doc_id, x.start, x.end, x.removed) for x in line_dedup.passages(df).collect()}
    want = brute_passages(rows, line_dedup.PASSAGE)
    assert got == want and {k for k, *_ in want} == {0, 1, 2, 11, None}
    assert line_dedup.passages(df.limit(0)).collect() == []


def test_removed_leaves_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8), (2, "a b c", 9, 10)], "doc_id long, text string, r_doc int, c0 int")
    out = {r.doc_id: (r.text, r.r_doc, r.c0, r.removed) for r in line_dedup.removed(df).collect()}
    assert out == {1: ("a b c", 7, 8, None), 2: ("", 9, 10, [(0, 5)])}
