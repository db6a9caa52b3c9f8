import random

import numpy as np
import pytest

from lexspark.llm import decontaminate, near_dup

DOCS = "doc_id long, text string, node int, a int, bucket string, hash int"


def jaccard(a, b):
    """Probability Jaccard by its definition."""
    from collections import Counter

    a, b = Counter(a), Counter(b)
    keys = a.keys() | b.keys()
    if not keys:
        return 1.0
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in keys) for x in a.keys() & b.keys())


def test_probability_jaccard():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = r.integers(0, 9, r.integers(0, 14)), r.integers(0, 9, r.integers(0, 14))
        assert near_dup.probability_jaccard(a, b) == pytest.approx(jaccard(a.tolist(), b.tolist()))


def test_signatures_estimate_it():
    r = np.random.default_rng(4)
    a = r.integers(0, 2**62, 300)
    lists = [a, np.concatenate([a[:240], r.integers(0, 2**62, 40)]), np.concatenate([a, a[:50]]), a[:1], a[:0]]
    s = near_dup.signatures(*near_dup.weighted(lists), len(lists), 4096)
    for i in range(3):
        for j in range(i):
            assert (s[i] == s[j]).mean() == pytest.approx(jaccard(lists[i].tolist(), lists[j].tolist()), abs=0.04)
    assert set(s[3]) == {np.uint64(a[0])} and not s[4].any()
    alone = near_dup.signatures(*near_dup.weighted(lists[1:2]), 1, 4096)
    assert (alone[0] == s[1]).all()  # not a matter of the batch


def shingles(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = [None, "", "  ", "one two", "One  Two", "one three"]
    for _ in range(12):
        base = [word() for _ in range(r.choice([8, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            near = [word() if r.random() < r.choice([0.002, 0.01, 0.03, 0.08]) else w for w in base]
            texts.append(" ".join(near))
    texts += ["spam ham " * 30, "spam ham " * 60, "spam ham " * 2000]
    r.shuffle(texts)
    return texts


def brute(texts):
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    s = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (not s[i] and not s[j]) or (set(s[i]) & set(s[j]) and jaccard(s[i], s[j]) >= 0.8):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1024, 3])
def test_classes_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = corpus()
    rows = [(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, texts[7], 1, 2, "x", 3)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute(texts)
    got = near_dup.classes(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == dict(enumerate(want))
    assert [r.class_id for r in got if r.doc_id is None] == [want[7]]
    if block == 3:
        out = near_dup.deduplicated(df).collect()
        assert sorted(r.doc_id for r in out) == sorted(set(want))
        assert near_dup.classes(df.limit(0)).collect() == near_dup.deduplicated(df.limit(0)).collect() == []


ITEMS = [
    (0, "A train leaves Boston at 60 km per hour. Later that day Anna walks 5 km with Peter and Anna returns 60 minutes later. How far did Anna go?"),
    (1, "which of the following animals is known to build large dams across rivers"),
    (2, None),
    (3, ""),
    (4, "is water really wet"),
    (5, "12 13 14"),
]


def test_leaks(spark):
    other = ITEMS[0][1].replace("Boston", "Denver").replace("60", "75").replace(" 5 km", " 9 km").replace("Anna", "Maria").replace("Peter", "John")
    broken = ITEMS[0][1].replace("Anna walks", "Maria walks").replace("Anna returns", "Julia returns").replace("Anna go", "Olga go")
    texts = {
        0: "Intro words here. " + ITEMS[0][1] + " And more text follows.",
        1: "Some text. " + other,
        2: "Some text. " + broken,
        3: ITEMS[1][1].upper() + "?!",
        4: "which of the following animals is not a mammal at all",
        5: None,
        6: "",
        7: "they ask: is water really wet? yes",
        8: "12 13 14 " * 5000,
        9: "filler " * 30_000 + ITEMS[1][1],
    }
    rows = [(k, t, 1, 2, "x", 3) for k, t in texts.items()] + [(3, texts[3], 1, 2, "x", 3), (None, ITEMS[1][1], 1, 2, "x", 3)]
    df, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(df, items).collect()}
    assert got == {(0, 0, "verbatim"), (1, 0, "reparameterised"), (3, 1, "verbatim"), (9, 1, "verbatim"), (None, 1, "verbatim"), (7, 4, "verbatim")}
    left = decontaminate.clean(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 8]
    assert decontaminate.leaks(df, items.limit(0)).collect() == decontaminate.leaks(df.limit(0), items).collect() == []


def test_items_of_few_words_are_found_verbatim(spark):
    items = [
        (0, "Compute 348 * 27 + 915 / 5 - 63"),
        (1, "Values 11 12 13 14 15 16 17 18 19 20 21 22"),
        (2, "he saw Anna Peter Maria John Julia Olga Boston Denver 5 km 7 km 9 km 3 km"),
        (3, "5"),
        (4, "which of the following animals builds large dams 1 2 3 4 5 6 7 8 9 10 11 12"),
    ]
    texts = {
        0: "Please Compute 348 * 27 + 915 / 5 - 63 now",
        1: "compute 349 * 27 + 915 / 5 - 63",
        2: "a list 5 " + items[1][1] + " 5 6",
        3: "values 11 12 13 14 15 99 17 18 19 20 21 22",
        4: "then " + items[2][1],
        5: "then he saw Anna Peter Maria John Julia Olga Boston Denver 6 km 8 km 9 km 3 km",
        6: "5",
        7: "no dams here 1 2 3 4 5 6 7 8 9 10 11 12",
    }
    df = spark.createDataFrame([(k, t, 1, 2, "x", 3) for k, t in texts.items()], DOCS)
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0, "verbatim"), (2, 1, "verbatim"), (4, 2, "verbatim"), (5, 2, "verbatim"), (7, 4, "verbatim")}


@pytest.mark.parametrize("last", [0, 10, 10_000])
def test_components_against_brute_force(spark, last):
    r = random.Random(9)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(90)] + [(300, 300)]
    r.shuffle(edges)
    up = {x: x for e in edges[:] for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        up[top(a)] = top(b)
    name = lambda x: x.to_bytes(16, "big")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(x.node, "big"): int.from_bytes(x.root, "big") for x in near_dup.components(df, last).collect()}
    want = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == want
    groups = lambda f: {frozenset(y for y in want if f(y) == f(x)) for x in want}
    assert groups(got.get) == groups(top)
    assert near_dup.components(df.limit(0), last).collect() == []
