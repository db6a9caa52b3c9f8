"""Queries over search, vectors and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import feedback as B
from ..operators import search as S
from .base import ALL, registry, table

QUERIES, ORACLE_SQL, query = registry()

_BM25 = f"""d AS (SELECT doc_id, {ALL} AS t FROM documents), z AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({ALL}) AS term FROM benchmark) GROUP BY 1, 2),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    df AS (SELECT term, ln((any_value(n) + 1) / count(*)) AS idf FROM tf, z GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum(qf * idf * (1.0 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), z GROUP BY 1, 2),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm")
def bm25plus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25_plus(table(spark, sf_dir, "documents"), _questions(spark, sf_dir))


_QUERY_VECTORS = "qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
_NEAR = f"""{_QUERY_VECTORS}, sim AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))), 6) AS similarity FROM embeddings, qv),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim) WHERE rank <= 10)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id 50 divides, against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return S.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query(f"WITH {_NEAR} SELECT query_id, vec_id, similarity, rank FROM near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query(f"WITH {_NEAR} SELECT query_id, vec_id, similarity, rank FROM near WHERE query_id IN (SELECT query_id FROM near WHERE rank = 2 AND similarity >= 0.4)")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches whose best hit, itself left out, is good enough."""
    n = _nearest(spark, sf_dir)
    other = n.withColumn("similar", F.when(F.col("rank") == 2, F.col("similarity")))
    return S.gated(other, 0.4, "similar").drop("similar")


@query(f"""WITH {_NEAR}, m AS (SELECT *, avg(similarity) OVER (PARTITION BY query_id) AS mean FROM near),
           k AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM m WHERE similarity >= round(mean, 6) AND similarity >= 0.3)
           SELECT query_id, vec_id, similarity, rank FROM k WHERE rank <= 5""")
def mean_cutoff_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.above_mean(_nearest(spark, sf_dir), 0.3, 5)


@query(f"""WITH {_BM25}, l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY h, doc_id) AS rank FROM
               (SELECT b.item_id AS query_id, d.doc_id, abs(length(d.text) - length(b.text)) AS h FROM documents d, benchmark b) QUALIFY rank <= 10),
           u AS (SELECT query_id, doc_id, 0.9 / (60 + rank) AS p FROM bm UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM l),
           f AS (SELECT query_id, doc_id, round(sum(p), 8) AS score, count(*) AS n_lists FROM u GROUP BY 1, 2)
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25+ fused with a second ranking, here by closeness of length."""
    from pyspark.sql import Window

    d, q = table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    size = d.where("text is not null").select("doc_id", F.length("text").alias("n")).join(F.broadcast(q.select("query_id", F.length("text").alias("m"))), F.lit(True))
    w = Window.partitionBy("query_id").orderBy(F.abs(F.col("n") - F.col("m")), "doc_id")
    near = size.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return S.fused([(S.bm25_plus(d, q), 0.9), (near, 1.0)], "doc_id")


@query("SELECT source, count(*) AS n, CAST(least(20, greatest(5, floor(count(*) / 3))) AS BIGINT) AS k FROM documents GROUP BY source")
def adaptive_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("k", S.candidate_k(F.col("n")).cast("long"))


@query("""WITH p AS (SELECT a.vec_id, b.vec_id AS earlier, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) AS s
          FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)
          SELECT vec_id, arg_max(earlier, (s, -earlier)) AS earlier, max(s) AS similarity FROM p WHERE s >= 0.35 GROUP BY 1""")
def redundant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.redundant(table(spark, sf_dir, "embeddings"), 0.35)


@query("""WITH x AS (SELECT label AS k, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
          g AS (SELECT k, dim, count(*) AS n, avg(v) AS m, sum(v * v) AS q FROM x GROUP BY 1, 2), t AS (SELECT dim, avg(v) AS a FROM x GROUP BY 1),
          s AS (SELECT sum(n * (m - a) * (m - a)) AS b, sum(q - n * m * m) AS w, count(DISTINCT k) AS k, sum(n) / count(DISTINCT dim) AS n FROM g JOIN t USING (dim))
          SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz, k AS n_clusters FROM s""")
def calinski_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calinski_harabasz(table(spark, sf_dir, "embeddings"))


@query()
def kmeans_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.key_passages(table(spark, sf_dir, "embeddings"), 8)


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def feedback_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return B.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT event_id, round(greatest(pow(0.5, date_diff('day', CAST(ts AS DATE), DATE '2025-01-31') / 1270.0), 0.55), 8) AS weight FROM events""")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.sample_weight(F.to_date("ts"), F.lit("2025-01-31").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", F.round(w, 8).alias("weight"))


@query("""SELECT event_type, CASE WHEN c <= 1 THEN '1' WHEN c <= 3 THEN '2-3' WHEN c <= 6 THEN '4-6' WHEN c <= 20 THEN '7-20' ELSE '21+' END AS bin, count(*) AS n
          FROM (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    return c.groupBy("event_type", T.count_bin(F.col("c")).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT d.source, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS p FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
          w AS (SELECT *, CASE WHEN n < 30 THEN 0.0 WHEN n < 60 THEN 0.25 WHEN n < 120 THEN 0.35 WHEN n < 250 THEN 0.45 ELSE 0.55 END AS w FROM l)
          SELECT source, n, greatest(0.0, least(100.0, round(60.0 * (1 - w) + 100 * p * w, 1))) AS score FROM w""")
def ml_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base score of 60 for each source, mixed with its share of good documents."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = x.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("p"))
    return g.select("source", "n", B.blended(F.lit(60.0), F.col("p"), B.ml_weight(F.col("n"))).alias("score"))


@query()
def train_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = B.train(d, table(spark, sf_dir, "labels"))
    return B.predict(model, d)


@query("""WITH t(term) AS (VALUES ('the and'), ('license'), ('of the')), h AS (SELECT term, doc_id, text, (length(text) - length(replace(lower(text), term, ''))) // length(term) AS n FROM documents, t WHERE contains(lower(text), term))
          SELECT term, doc_id, n AS n_hits, count(*) OVER (PARTITION BY term) AS n_docs FROM h""")
def snippet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("the and",), ("license",), ("of the",)], "term string")
    s = C.snippets(table(spark, sf_dir, "documents"), terms, most=1).select("term", "doc_id", "n_hits")
    n = s.groupBy("term").agg(F.count("*").alias("n_docs"))
    return s.join(n, "term")


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("the and",), ("license",), ("of the",)], "term string")
    return C.snippets(table(spark, sf_dir, "documents"), terms)
