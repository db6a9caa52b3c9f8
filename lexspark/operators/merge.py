"""Merging of candidates, statistics over sources, and gibberish scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Which type wins where extractors disagree.
PRECEDENCE = {"Person": 9, "Place": 7, "Medical": 5, "Acronym": 3, "Technical": 1}


def merged(candidates: DataFrame, weights: dict[str, float], default: float = 0.5) -> DataFrame:
    """(key, term, frequency, n_algorithms, confidence, type) by normalised term.

    Two steps of one grouping: spellings first, so the canonical casing (the most
    frequent, then mixed case) needs no join.
    """
    by = lambda c, values, other: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in values.items()], F.lit(other))
    g = candidates.withColumns({"key": T.merge_key(F.col("term")), "weight": by("algorithm", weights, default), "prec": by("type", PRECEDENCE, 0)})
    mixed = (F.col("term") != F.lower("term")) & (F.col("term") != F.upper("term"))
    s = g.groupBy("key", "term").agg(
        F.sum("frequency").alias("n"), F.collect_set("algorithm").alias("algorithms"), F.sum(F.col("confidence") * F.col("weight")).alias("cw"), F.sum("weight").alias("w"),
        F.max(F.struct("prec", "type")).alias("best"),
    )
    m = s.groupBy("key").agg(
        F.max_by("term", F.struct("n", mixed.cast("int"), "term")).alias("term"), F.sum("n").alias("frequency"),
        F.size(F.array_distinct(F.flatten(F.collect_set("algorithms")))).cast("long").alias("n_algorithms"),
        F.round(F.sum("cw") / F.sum("w"), 6).alias("confidence"), F.max("best")["type"].alias("type"),
    )
    return m


def source_stats(sources: DataFrame, exact: bool = False) -> DataFrame:
    """Statistics of each term over its sources. sources: (term, source, confidence, n)."""
    r = (lambda c, d=9: c) if exact else (lambda c, d=9: F.round(c, d))
    c, n = F.col("confidence"), F.col("n")
    s = sources.groupBy("term").agg(
        F.sum("n").alias("total"), r(F.sum(c * n) / F.sum(n)).alias("mean"), r(F.min(c)).alias("least"), r(F.max(c)).alias("most"), r(F.stddev_pop(c)).alias("spread"),
        r(F.avg(F.when(c > 0.8, 1.0).otherwise(0.0))).alias("high_ratio"), F.bool_and(c < 0.6).alias("all_low"), r(F.pow(F.sum(c * n), F.lit(1.1)), 4).alias("weighted"),
        F.count("*").alias("docs"),
    )
    return s if exact else s.drop("docs")


def gibberish(docs: DataFrame, least: int = 4) -> DataFrame:
    """(term, surprise): the mean of -log2 P(letter | letter before) over a word, boundaries included."""
    w = docs.select(F.explode(T.tokens(F.col("text"), least)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    bound = F.concat(F.lit("^"), F.col("term"), F.lit("$"))
    p = w.select("term", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("term") + 1), lambda i: F.substring(bound, i, F.lit(2)))).alias("pair"))
    pair = p.groupBy("pair").agg(F.sum("n").alias("k"))
    first = pair.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("k").alias("all"))
    cost = pair.withColumn("a", F.substring("pair", 1, 1)).join(first, "a").select("pair", (-F.log2(F.col("k") / F.col("all"))).alias("cost"))
    return p.join(F.broadcast(cost), "pair").groupBy("term").agg(F.round(F.avg("cost"), 6).alias("surprise"), F.max("n").alias("n"))
