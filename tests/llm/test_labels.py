import math
import random

import pytest
from pyspark.sql import functions as F

from lexspark.llm import quality


def test_every_label_counts(spark):
    n = 250_000
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    ids = quality.trusted_ids(labels, 200_000)
    assert ids.count() == n and ids.where("quality = 1").count() == n // 2
    docs = labels.select("doc_id", F.concat(F.lit("plain word of row k"), F.col("doc_id") % 7).alias("text"))
    # five words and four pairs a text; the first word stands in all of them
    p = lambda c, m: (c + quality.ALPHA) / (9 * m + quality.ALPHA * quality.BUCKETS)
    want = math.log(p(n // 2, n // 2) / p(n, n))
    assert any(abs(x.ratio - want) < 1e-9 for x in quality.ratios(docs, ids, broadcast_rows=100_000).collect())


@pytest.mark.parametrize("rows", [0, 5])
def test_shuffled_labels_give_the_same_verdicts(spark, rows):
    r = random.Random(rows)
    texts = [" ".join(r.choice(["good fine clean", "spam buy now", "the of and"]) + f" {r.randrange(99)}" for _ in range(r.randint(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[9]), (None, texts[5]), (None, None), (70, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("good" in t), 0) for i, t in enumerate(texts) if i % 3] + [(4, 0, 0), (None, 1, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    rank = lambda out: sorted(((*x[:-1], round(x.score, 9)) for x in out.collect()), key=str)
    want, kept = rank(quality.judge(docs, labels)), sorted(map(str, quality.kept(docs, labels).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = quality.trusted_ids(labels, rows)
        assert "BroadcastHashJoin" not in docs.join(ids, "doc_id")._jdf.queryExecution().executedPlan().toString()
        assert rank(quality.judge(docs, labels, broadcast_rows=rows)) == want
        assert sorted(map(str, quality.kept(docs, labels, broadcast_rows=rows).collect())) == kept
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
