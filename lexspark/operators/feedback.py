"""Feedback: last write wins, decayed weights, and a model of what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record of each key. A maximum over a struct needs no sort and sums up before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return records.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


def sample_weight(time: Column, now: Column, half_life: float = 1270.0, floor: float = 0.55, unknown: float = 0.75) -> Column:
    """Halves every half_life days, not below floor; a missing time weighs ``unknown``."""
    return F.when(time.isNull(), unknown).otherwise(F.greatest(F.pow(F.lit(0.5), F.datediff(now, time) / half_life), F.lit(floor)))


def ml_weight(n: Column) -> Column:
    return F.when(n < 30, 0.0).when(n < 60, 0.25).when(n < 120, 0.35).when(n < 250, 0.45).otherwise(0.55)


def blended(base: Column, probability: Column, weight: Column) -> Column:
    """A score of 0 to 100 mixed with a model's probability."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(base * (1 - weight) + 100 * probability * weight, 1)))


def features(docs: DataFrame) -> DataFrame:
    """Plain figures of a text for the keep-or-skip model."""
    t = F.coalesce("text", F.lit(""))
    words = F.regexp_count(t, F.lit(r"\S+"))
    return docs.select(
        "doc_id",
        F.log1p(words).alias("words"),
        (F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.length(t), F.lit(1))).alias("capitals"),
        (F.regexp_count(t, F.lit("[0-9]")) / F.greatest(F.length(t), F.lit(1))).alias("digits"),
        (F.regexp_count(t, F.lit("[#*$%&|<>!]")) / F.greatest(F.length(t), F.lit(1))).alias("symbols"),
        (F.length(t) / F.greatest(words, F.lit(1))).alias("word_length"),
    )


def train(docs: DataFrame, labels: DataFrame, least: int = 30):
    """A pipeline of scaler and logistic regression, classes balanced; None with fewer than ``least`` labelled rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = features(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sum(n.values()) < least or len(n) < 2:
        return None
    total = sum(n.values())
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
    names = [c for c in features(docs).columns if c != "doc_id"]
    lr = LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=1 / total, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr]).fit(rows)


def predict(model, docs: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features(docs)).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("keep"))


def valid(records: DataFrame) -> DataFrame:
    """Records with a term, a rating and a time."""
    filled = lambda c: F.coalesce(F.btrim(F.col(c).cast("string")) != "", F.lit(False))
    return records.where(filled("term") & filled("feedback") & filled("timestamp"))


def without_ratings(records: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """records without those of the keys in gone; an equi anti join, so gone may be of any size."""
    return records.join(gone.select(*keys).distinct(), keys, "left_anti")


def rated(records: DataFrame, rating: int | None = None) -> DataFrame:
    """(term, feedback) of the terms rated last with that rating, or with any but 0."""
    last = last_wins(records.select(F.lower("term").alias("term"), "feedback", "ord"), ["term"], ["ord"])
    return last.where(F.col("feedback") == rating if rating is not None else F.col("feedback") != 0).select("term", "feedback")


def forest_weight(n: Column) -> Column:
    """The forest's share of a prediction by the number of samples; null from 200 on, where confidence decides."""
    return F.when(n < 40, 0.0).when(n < 60, 0.10).when(n < 100, 0.20).when(n < 150, 0.30).when(n < 200, 0.40)


def by_confidence(a: Column, b: Column) -> Column:
    """Two probabilities, each weighted by its distance from one half; one half if both are."""
    x, y = F.abs(a - 0.5), F.abs(b - 0.5)
    return F.when(x + y == 0, 0.5).otherwise((a * x + b * y) / (x + y))


def source_weight(own: Column, user: Column) -> Column:
    """What a record weighs by its source (own: a user's) and the number of a user's records."""
    steps = [(1, 1.0, 1.0), (3, 1.0, 1.5), (10, 1.0, 2.0), (25, 0.95, 2.5), (50, 0.9, 3.0), (100, 0.8, 3.5), (200, 0.7, 4.0)]
    out = F.when(own, 5.0).otherwise(0.6)
    for most, default, users in reversed(steps):
        out = F.when(user < most, F.when(own, users).otherwise(default)).otherwise(out)
    return out


#: Least labelled rows of a class, and rows from which a forest is fitted.
CLASS_ROWS, FOREST_ROWS = 3, 40


def train_ensemble(docs: DataFrame, labels: DataFrame, least: int = 30):
    """(regression, forest, rows): the logistic regression, from 40 rows on a forest of 23 trees beside it, and the labelled rows; None with too few."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = features(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if total < least or len(n) < 2 or min(n.values()) < CLASS_ROWS:
        return None
    regression = train(docs, labels, least)
    if total < FOREST_ROWS:
        return regression, None, total
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
    names = [c for c in features(docs).columns if c != "doc_id"]
    forest = RandomForestClassifier(featuresCol="scaled", weightCol="weight", numTrees=23, maxDepth=10, minInstancesPerNode=5, seed=42)
    return regression, Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), forest]).fit(rows), total


def predict_ensemble(models, docs: DataFrame) -> DataFrame:
    """(doc_id, keep): one half without a model; both models blended by the number of rows, from 200 on by their confidence."""
    if models is None:
        return docs.select("doc_id", F.lit(0.5).alias("keep"))
    regression, forest, rows = models
    a = predict(regression, docs)
    if forest is None:
        return a
    from pyspark.ml.functions import vector_to_array

    b = forest.transform(features(docs)).select("doc_id", vector_to_array("probability")[1].alias("b"))
    n, x, y = F.lit(rows), F.col("keep"), F.col("b")
    both = F.coalesce(x * (1 - forest_weight(n)) + y * forest_weight(n), by_confidence(x, y))
    return a.join(b, "doc_id").select("doc_id", F.round(both, 6).alias("keep"))
