from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from lexspark.llm import segmentations as seg

FILE = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids int, t string, sample string"


@pytest.fixture(scope="module")
def pieces():
    return seg.Pieces(open(FILE, "rb").read())


def every_path(pieces, token):
    """(ids, log weight) of all segmentations of one token, by brute force."""
    import math

    by = {pieces.text[i].decode(): i for i in range(259, len(pieces.text))}
    t, out = token.replace(seg.SPACE, " "), []
    for cuts in product([0, 1], repeat=len(t) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(t[at:k])
                at = k
        parts.append(t[at:])
        ids, log = [], 0.0
        for p in parts:
            if p in by:
                ids.append(by[p])
                log += pieces.log[by[p]]
            elif len(p) == 1:
                b = p.encode()
                ids += pieces.byte[list(b)].tolist()
                log += pieces.byte_log * len(b)
            else:
                break
        else:
            out.append((tuple(ids), log))
    z = math.log(sum(math.exp(x) for _, x in out))
    return {i: x - z for i, x in out}


def test_all_paths_and_their_probabilities(pieces):
    for text in ["the cat", "é⁇", "a  b", "x\ny"]:
        want = {(): 0.0}
        for t in [seg.SPACE + x for x in seg._split(text)]:
            want = {a + b: x + y for a, x in want.items() for b, y in every_path(pieces, t).items()}
        got = seg.sampled(pieces, [text], np.array([5]), len(want) + 3)[0]
        assert len(got) == len(want)
        assert {tuple(i.tolist()): pytest.approx(p, abs=1e-6) for i, p, _, _ in got} == want
        perturbed = [g for _, _, g, _ in got]
        assert perturbed == sorted(perturbed, reverse=True) and all(inc == 0.0 for *_, inc in got)


def test_sample_without_replacement(pieces):
    """First draws follow the path probabilities, second draws the remaining ones."""
    text, n = "the cat", 6000
    want = {(): 0.0}
    for t in [seg.SPACE + x for x in seg._split(text)]:
        want = {a + b: x + y for a, x in want.items() for b, y in every_path(pieces, t).items()}
    p = {k: np.exp(v) for k, v in want.items()}
    got = seg.sampled(pieces, [text] * n, np.arange(n) * 7919, 2)
    first = Counter(tuple(x[0][0].tolist()) for x in got)
    second = Counter(tuple(x[1][0].tolist()) for x in got)
    for k in p:
        assert first[k] / n == pytest.approx(p[k], abs=0.025)
        assert second[k] / n == pytest.approx(sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k), abs=0.025)
    assert all(x[0][0].tolist() != x[1][0].tolist() for x in got)


def test_round_trip_and_rows(spark):
    texts = [None, "", " ", "  two  spaces ", "Ünïcode 😀 \x00 \n\t end", "word " * 6000, "x" * 4000, "a▁b", "plain text here"]
    rows = [(i, t, 1, "", "") for i, t in enumerate(texts)] + [(None, "no key", 1, "", ""), (8, texts[8], 1, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    enc = seg.encode(df, FILE, samples=3)
    out = seg.decode(enc, FILE).collect()
    by = {}
    for r in out:
        assert r.decodes and r.n_pieces == len(r.ids) and r.log_inclusion <= 0
        by.setdefault(r.doc_id, []).append(r)
    for k, t, *_ in rows:
        assert {r.text for r in by[k]} == {(t or "").replace("▁", " ")}
        per = {tuple(r.ids) for r in by[k]}
        assert len(per) == (1 if not t else min(3, len(per)))
        assert [r.sample for r in by[k]] == (list(range(1, len(per) + 1)) * (2 if k == 8 else 1))
    again = {(r.doc_id, r.sample): tuple(r.ids) for r in seg.encode(df.repartition(3), FILE, samples=3).collect()}
    assert again == {(r.doc_id, r.sample): tuple(r.ids) for r in out}
    assert seg.encode(df.limit(0), FILE).collect() == []
