import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexspark.llm import interpolation as lm

DOCS = "doc_id long, text string, key int, fold int, c string"


def texts():
    r = random.Random(2)
    vocab = ["w%d" % int(r.paretovariate(0.7)) for _ in range(400)]
    out = [None, "", "É É one\x0btwo THREE", " x y"]
    for _ in range(150):
        at, words = r.randrange(400), []
        for _ in range(r.randint(1, 60)):
            at = (at * 7 + 3) % 400 if r.random() < 0.6 else r.randrange(400)
            words.append(vocab[at])
        out.append(r.choice([" ", "\n", "  "]).join(words))
    return out


def brute(rows, head_of, weights=None):
    """The contract's base figures, and the model by its formulas; head_of: the words with symbols of their own."""
    import re

    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10
    train = [cut(t) + [None] for k, t, *_ in rows if fold(k)]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    out = []
    for k, t, *_ in rows:
        d = cut(t) + [None]
        out.append([k, not fold(k), len(d), sum(c[w] > 0 for w in d), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d)])
    return out, c, n, v, train, cut


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_scores_against_brute_force(spark, head, monkeypatch):
    rows = [(i, t, 1, 1, "x") for i, t in enumerate(texts())]
    rows += rows[5:8] + [(None, "w1 w2 w1", 1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    kept = {}
    real = lm.learned
    monkeypatch.setattr(lm, "learned", lambda cells: kept.setdefault("w", real(cells)))
    got = lm.score(df, head=head).collect()
    want, c, n, v, train, cut = brute(rows, None)
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((norm(r[:6]) for r in got), key=str) == sorted(map(norm, want), key=str)
    # the head: whole frequency classes from the top
    bins = Counter(math.floor(8 * math.log2(x)) for w, x in c.items() if w is not None)
    top, room = set(), head
    for b in sorted(bins, reverse=True):
        if bins[b] > room:
            break
        top.add(b)
        room -= bins[b]
    own = {w for w, x in c.items() if w is not None and math.floor(8 * math.log2(x)) in top}
    sym = lambda w: w if w is None or w in own else "RARE"
    pair = Counter((sym(a) if a else a, sym(b)) for d in train for a, b in zip(["", *d[:-1]], d))
    uni = Counter(sym(w) for d in train for w in d)
    ctx = Counter(uni) | Counter({"": len(train)})
    weights = kept["w"]
    size, total = len(own), sum(uni.values())
    score = {}
    for k, t, *_ in rows:
        d, s = [*cut(t), None], 0.0
        for a, b in zip(["", *d[:-1]], d):
            a2, b2 = (sym(a) if a else a), sym(b)
            x = ctx[a2]
            w = weights[math.floor(math.log2(x)) + 1 if x else 0]
            s += math.log10(w[0] * pair[a2, b2] / max(x, 1) + w[1] * uni[b2] / total + w[2] * (uni[b2] + 0.1) / (total + 0.1 * (size + 2)))
            if b2 == "RARE":
                s += math.log10((c[b] + 0.1) / (uni["RARE"] + 0.1 * (v - 1 - size + 1)))
        score[k, t] = s
    assert all(r.score == pytest.approx(score[k, t], abs=1e-6) for r in got for k, t, *_ in rows if (k, len(cut(t)) + 1) == (r.doc_id, r.n_tokens))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the text has two-word regularities
    assert lm.score(df.limit(0)).collect() == []


def test_weights_maximise_the_likelihood():
    r = np.random.default_rng(1)
    cells = [(3, int(q2), int(q1), int(n)) for q2, q1, n in zip(r.integers(-20, 60, 40), r.integers(-20, 30, 40), r.integers(1, 50, 40))]
    w = lm.learned(cells)[3]
    like = lambda x: sum(n * math.log(x[0] * 2 ** (a / 8) + x[1] * 2 ** (b / 8) + x[2]) for _, a, b, n in cells)
    assert w.sum() == pytest.approx(1)
    for _ in range(50):
        assert like(w) >= like(r.dirichlet([1, 1, 1])) - 0.5


@pytest.mark.parametrize("many", [False, True])
def test_words_beyond_the_table_stay_apart(spark, many, monkeypatch):
    rows = [(i, t, 1, 1, "x") for i, t in enumerate(texts())]
    rows += rows[5:8] + [(None, "w1 w2 w1", 1, 1, "x"), (900, "new1 new2 new1 new2 w1", 1, 1, "x")]
    if many:  # more words than the broadcast table takes, most of them seen once, in pairs that come back
        rows += [(1000 + i, " ".join(f"x{k // 2 if k % 7 else k}" for k in range(i * 10_000, i * 10_000 + 12_000)), 1, 1, "x") for i in range(60)]
    kept = {}
    real = lm.learned
    monkeypatch.setattr(lm, "learned", lambda cells: kept.setdefault("w", real(kept.setdefault("cells", cells))))
    got = lm.score(spark.createDataFrame(rows, DOCS), table=lm.HEAD if many else 40).collect()
    want, c, n, v, train, cut = brute(rows, None)
    assert not many or v > lm.HEAD
    norm = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    assert sorted((norm(r[:6]) for r in got), key=str) == sorted(map(norm, want), key=str)
    pair = Counter((a, b) for d in train for a, b in zip(["", *d[:-1]], d))
    context = c | Counter({"": len(train)})
    # as many held-out occurrences in each bucket as the deleted fold has
    folds = [(zlib.crc32(("" if k is None else str(k)).encode()) % 10, [*cut(t), None]) for k, t, *_ in rows]
    left = Counter(a for f, d in folds if f > 1 for a in ["", *d[:-1]])
    held, bucket = Counter(), lambda x: math.floor(math.log2(x)) + 1 if x else 0
    for f, d in folds:
        if f == 1:
            held.update(bucket(left[a]) for a in ["", *d[:-1]])
    mine = Counter()
    for b, _, _, x in kept["cells"]:
        mine[b] += x
    assert mine == held
    score = {}
    for k, t, *_ in rows:
        d, s = [*cut(t), None], 0.0
        for a, b in zip(["", *d[:-1]], d):
            x = context[a]
            w = kept["w"][bucket(x)]
            s += math.log10(w[0] * pair[a, b] / max(x, 1) + w[1] * c[b] / n + w[2] * (c[b] + 0.1) / (n + 0.1 * (v + 1)))
        score.setdefault((k, len(d)), []).append(s)
    assert all(any(r.score == pytest.approx(s, rel=1e-9, abs=1e-6) for s in score[r.doc_id, r.n_tokens]) for r in got)
