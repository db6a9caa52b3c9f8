import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexspark import catalog
from lexspark.functions import strings as S
from lexspark.operators import terms


@pytest.mark.parametrize("texts", [["Clase que, ése que; se queñ; se que_ se que2 SE QUE. se  que", None, ""], ["se que se que\nse quese que", "Sİ se queı İse que"]])
def test_phrase_counts_at_letters_outside_ascii(spark, tmp_path, texts):
    spark.createDataFrame([(0, "Se que os"), (50, "si se"), (100, "?"), (150, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for t in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(db.execute(catalog.ORACLE_SQL["phrase_counts"]).fetchall())
    assert len(want) == 2 and want[0][2] > 1
    assert sorted(tuple(r) for r in catalog.QUERIES["phrase_counts"](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_phrase_counts_of_every_item(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(terms, "PHRASE_BYTES", broadcast)
    items = [(1, "Ha ha!"), (2, "ha 7 BO, ha"), (3, "bo"), (7, "bo ha"), (7, "Bo. Ha"), (-50, "bo zu"), (50, "zu zu"), (51, "é"), (52, None), (None, "ha bo")]
    r = random.Random(7)
    texts = ["".join(r.choice(["ha", "Ha", "bo", "zu", "ha2", "_", "é"]) + r.choice([" ", " ", " ", "  ", ", ", "\n", "-", ""]) for _ in range(n)) for n in (2, 30, 400, 3000)]
    texts += ["ha ha ha", "ha ha ha ha ha bo bo", None, ""]
    want = {}
    for i, t in items:
        p = " ".join(re.findall("[A-Za-z]+", t or "")[:2]).lower()
        if p:
            want[i, p] = want.get((i, p), 0) + sum(len(re.findall(rf"(?a:\b){p}(?a:\b)", (x or "").lower())) for x in texts)
    assert len(want) == 7 and want[-50, "bo zu"] > 0
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db, run = duckdb.connect(), lambda: sorted(map(str, (tuple(x) for x in catalog.QUERIES["phrase_counts"](spark, str(tmp_path)).collect())))
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    for some, rows in ((texts, want), ([None], {})):
        spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert run() == sorted(str((*k, n)) for k, n in rows.items())
        db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert run() == sorted(map(str, db.execute(catalog.ORACLE_SQL["phrase_counts"]).fetchall()))


def test_phrase_count_between_letters_of_any_script(spark):
    t = spark.createDataFrame([("se que, ése que, se queñ, SE QUE; (a) b(a) c",)], "text string")
    assert tuple(t.select(S.phrase_count(F.lit("Se que"), F.col("text")), S.phrase_count(F.lit("(a)"), F.lit("b(a)c (a)")), S.phrase_count(F.lit(""), F.lit("ab é"))).first()) == (2, 1, 4)


def words_ranked(phrases, rounds=10, damping=0.85):
    """{word: rank} for the distinct phrases of a document, by plain loops."""
    nodes = sorted({w for p in phrases for w in p.split()})
    weight = {}
    for p in phrases:
        for a, b in itertools.permutations(set(p.split()), 2):
            weight[a, b] = weight.get((a, b), 0) + 1
    out = {a: sum(n for (x, _), n in weight.items() if x == a) for a in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes) if nodes else 0)
    for _ in range(rounds):
        rank = {b: (1 - damping) / len(nodes) + damping * sum(rank[a] * n / out[a] for (a, c), n in weight.items() if c == b) for b in nodes}
    return rank


@pytest.mark.parametrize("together", [5, 200_000])
def test_topicrank_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(terms, "RANKED_TOGETHER", together)
    r = random.Random(5)
    word = lambda: "".join(r.choices("bcdfgé", k=3)) + "x"
    texts = [" ".join(r.choice([word(), word(), "the", ",", "\n"]) for _ in range(n)) for n in (3, 40, 400, 2500)]
    rows = [*enumerate(texts), (7, "new new york, the york new"), (7, "york port the"), (8, None), (9, ""), (10, "the"), (None, "lost words")]
    found = {}
    for i, t in rows:
        runs = re.findall(r"[^\W]+|[^\w\s]|\n", (t or "").lower())
        marked = " ".join(x if re.fullmatch("[a-z]+", x) and len(x) >= 2 and x != "the" else "|" for x in runs)
        found.setdefault(i, set()).update(p.strip() for p in marked.split("|") if 0 < len(p.split()) <= 3)
    got = terms.topicrank(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # the longest text has more than the 200 phrases that were once looked at
    assert len(found[3]) > 200
    for i, p in found.items():
        want = words_ranked(p) if i is not None else {}
        mine = sorted((x for x in got if x.doc_id == i), key=lambda x: x.place)
        assert [x.place for x in mine] == list(range(1, min(20, len(want)) + 1))
        assert all(abs(x.score - want[x.term]) < 1e-7 for x in mine)
        assert [x.term for x in mine] == [x.term for x in sorted(mine, key=lambda x: (-x.score, x.term))]
        assert all(w in {x.term for x in mine} or s <= mine[-1].score + 1e-7 for w, s in want.items())


def test_topicrank_moves_no_text(spark):
    docs = spark.createDataFrame([(1, "steel port, port city the"), (2, "city")], "doc_id long, text string")
    assert "Exchange" not in terms.topicrank(docs)._jdf.queryExecution().executedPlan().toString()
