import hashlib
import random
import re

import pytest

from lexspark.llm import quality, secrets

WS = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, score int, cell string, q_h long, s_key int, start long"


def docs_of(spark, texts):
    rows = [(i, t, 1, "x", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [(None, "some text of a document without any id at all", 1, "x", 2, 3, 4), (1, texts[1], 1, "x", 2, 3, 4), (1, texts[1], 1, "x", 2, 3, 4)]
    return rows, spark.createDataFrame(rows, DOCS)


def base(t):
    t = t or ""
    w = re.findall(WS, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 4)))
    out = [None, "", "a b c d e " * 3, "one\ntwo\none\n\n  \none two", "x " * 5000, "𝒳y é\x0b\x0c\x1c|<>&& a b"]
    for _ in range(30):
        out.append(" ".join(word() for _ in range(r.randint(1, 120))) + r.choice(["", "\nabc abc\nabc abc"]))
    return out


def test_base_counts(spark, texts):
    rows, df = docs_of(spark, texts)
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r[:7] for r in quality.judge(df, labels).collect()), key=str)
    assert got == sorted(((k, *base(t)) for k, t, *_ in rows), key=str)
    assert quality.judge(df.limit(0), labels).collect() == []
    assert {r.kept for r in quality.judge(df, labels.limit(0)).collect()} == {True, False}


def test_ratio_against_plain_python(spark, texts):
    """The model scores texts as a straight count of cells does, and separates two vocabularies."""
    import math
    from collections import Counter

    _, df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(6, 30)], "doc_id long, quality int, toxic int")
    ids = quality.trusted_ids(labels, 1000)
    from pyspark.sql import functions as F

    from lexspark.llm.common import words

    cells = [(r.doc_id, r.c) for r in df.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).select("doc_id", quality.grams("h").alias("c")).collect()]
    raw = Counter(x for _, c in cells for x in c)
    good = Counter(x for k, c in cells for x in c if k is not None and 6 <= k < 30 and k % 2)
    p = lambda n, x: (n[x] + 1) / (sum(n.values()) + quality.BUCKETS)
    got = {r.cell: r.ratio for r in quality.ratios(df, ids).collect()}
    assert got == pytest.approx({x: math.log(p(good, x) / p(raw, x)) for x in raw})


def test_threshold():
    assert quality.threshold([(-5, 0, 4), (-4, 1, 4), (3, 9, 0)]) == -0.003
    assert quality.threshold([(1, 5, 0)]) == float("-inf") == quality.threshold([])


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    bases = sorted(out)
    weak = []
    for k, pattern in ((3, secrets.IDENT), (4, secrets.WEAK), (5, secrets.ENDPOINT)):
        weak += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if not any(s < m.end() and m.start() < e for s, _, e in bases)]
    role = lambda k: {1: "i", 3: "i", 5: "e"}.get(k, "s")
    kept = []
    for s, k, e in weak:
        near = {role(k2) for s2, k2, e2 in bases + weak if s2 <= e + secrets.SCOPE and e2 >= s - secrets.SCOPE}
        if (role(k) == "s" and near & {"i", "e"}) or (role(k) == "i" and "s" in near) or (role(k) == "e" and {"i", "s"} <= near):
            kept.append((s, k, e))
    return bases, sorted(bases + kept)


def written(x):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in x)


def secret_texts():
    r = random.Random(7)
    bits = ["password=token:abcdefgh", 'API_KEY" : "abcdef', "Secret=ab", "AKIA" + "A1" * 8, "AKIA" + "B" * 5, "0123456789abcdef" * 2, "client_id = foo-bar", "pwd: hunter22", "https://api.example.com/v1?x=1", "A" * 39 + "/", "é𝒳 word", "\n", "x" * 300, "login=me@x", "0a" * 11]
    out = [None, "", " ", "password" * 3]
    for _ in range(60):
        out.append(r.choice([" ", "\n", "é "]).join(r.choices(bits, k=r.randint(1, 14))))
    return out + ["w " * 50_000 + "token=abcdefg " * 300]


def test_spans_against_brute_force(spark):
    texts = secret_texts()
    rows, df = docs_of(spark, texts)
    got = sorted(map(tuple, secrets.report(df).collect()), key=str)
    want = []
    for k, t, *_ in rows:
        b, every = spans(t)
        want.append((k, *[sum(x[1] == n for x in b) for n in range(3)], hashlib.sha256(written(b).encode()).hexdigest(), written(every)))
    assert got == sorted(want, key=str)
    assert secrets.report(df.limit(0)).collect() == []


def test_redaction(spark):
    rows, df = docs_of(spark, secret_texts())
    out = secrets.redacted(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for k, t, *_ in rows:
        if k is None:
            continue
        want, at = "", 0
        for s, _, e in spans(t)[1]:
            if s >= at:
                want += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert got[k] == (t if t is None else want + t[at:])
