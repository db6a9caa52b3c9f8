"""What a reader of the vocabulary asks for: orders, filters, reasons, ids, and how many clusters to show."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, text: str, column: str = "term", regex: bool = False) -> DataFrame:
    """Rows whose column holds a text, without regard to case; an invalid pattern filters nothing."""
    if not regex:
        return df.where(F.contains(F.lower(column), F.lit(text.lower())))
    try:
        re.compile(text)
    except re.error:
        return df
    return df.where(F.col(column).rlike(f"(?i){text}"))


def numeric_first(column: str, ascending: bool = True) -> list[Column]:
    """Sort keys: as numbers where the text is one ("85%" is 85), else as lower-case text."""
    number = F.expr(f"try_cast(regexp_replace(cast({column} as string), '[%,]', '') as double)")
    text = F.lower(F.col(column).cast("string"))
    return [number.asc_nulls_last(), text.asc()] if ascending else [number.desc_nulls_last(), text.desc()]


def document_id(text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(F.substring(text, 1, 1000)), 1, 12))


def reasons(term: Column, count: Column, docs: Column) -> Column:
    """The rules that moved a term's score, as (reason, points), strongest first."""
    rule = lambda when, why, points: F.when(when, F.struct(F.lit(why).alias("reason"), F.lit(points).alias("points")))
    every = F.array(
        rule(count >= 100, "very frequent", 35), rule(docs >= 2, "in several documents", 10), rule((term == F.upper(term)) & (term != F.lower(term)), "all capitals", -12),
        rule(term.rlike("^[0-9]"), "begins with a digit", -8), rule(F.length(term) == 1, "a single letter", -15),
    )
    return F.array_compact(every)


def combined(corpora: list[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """The union of corpora; an id that occurs in several is prefixed by its corpus."""
    every = None
    for name, df in corpora:
        one = df.select(F.col(key).cast("string").alias("name"), F.lit(name).alias("corpus"))
        every = one if every is None else every.unionByName(one)
    twice = every.groupBy("name").agg(F.countDistinct("corpus").alias("k")).where("k > 1").select("name", F.lit(True).alias("clash"))
    return every.join(twice, "name", "left").select(F.when(F.col("clash"), F.concat_ws("_", "corpus", "name")).otherwise(F.col("name")).alias("name"), "corpus")


def choose_k(vectors: DataFrame, most: int = 15, seed: int = 42) -> int:
    """The number of clusters, up to ``most``, that two of three votes agree on, else their median.

    Votes: silhouette, the ratio of spreads (Calinski-Harabasz), and the lowest BIC of round clusters of one spread, from their sizes and cost.
    """
    from math import log, pi

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    n, silhouette, spread, bic = v.count(), {}, {}, {}
    if n < 10:
        return max(1, min(n, 2))
    variance = v.select(Summarizer.variance(F.col("features")).alias("x")).first().x
    dims, total = len(variance), float(sum(variance)) * (n - 1)
    for k in range(2, min(most, n // 2) + 1):
        model = KMeans(k=k, seed=seed, maxIter=20).fit(v)
        silhouette[k] = ClusteringEvaluator(distanceMeasure="cosine").evaluate(model.transform(v))
        cost, sizes = max(model.summary.trainingCost, 1e-12), model.summary.clusterSizes
        spread[k] = (total - cost) / (k - 1) / (cost / (n - k))
        likelihood = sum(x * log(x / n) for x in sizes if x) - n * dims / 2 * (log(2 * pi * cost / (n * dims)) + 1)
        bic[k] = k * (dims + 1) * log(n) - 2 * likelihood
    v.unpersist()
    votes = sorted([max(silhouette, key=silhouette.get), max(spread, key=spread.get), min(bic, key=bic.get)])
    return votes[1]
