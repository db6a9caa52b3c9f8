"""Queries of the display layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import display as D
from ..operators import terms as O
from .base import DF, registry, table

QUERIES, ORACLE_SQL, query = registry()


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.document_frequency(O.term_frequency(table(spark, sf_dir, "documents")))


@query(f"WITH {DF} SELECT term, df FROM dfq WHERE regexp_matches(term, '(?i)^th.*ing$')")
def term_regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.filtered(_counts(spark, sf_dir), "^th.*ing$", regex=True).select("term", "df")


@query(f"WITH {DF} SELECT term, df, row_number() OVER (ORDER BY df, term) AS place FROM dfq ORDER BY df, term LIMIT 200")
def rarest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a vocabulary by rarity."""
    from pyspark.sql import Window

    page = _counts(spark, sf_dir).select("term", "df").orderBy("df", "term").limit(200)
    return page.withColumn("place", F.row_number().over(Window.orderBy("df", "term")))


@query("SELECT doc_id, 'doc_' || substr(md5(substr(coalesce(text, ''), 1, 1000)), 1, 12) AS name FROM documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.document_id(F.coalesce("text", F.lit(""))).alias("name"))


@query(f"""WITH {DF} SELECT reason, CAST(points AS INTEGER) AS points, count(*) AS n FROM (
    SELECT 'very frequent' AS reason, 35 AS points FROM dfq WHERE cf >= 100 UNION ALL SELECT 'in several documents', 10 FROM dfq WHERE df >= 2 UNION ALL
    SELECT 'a single letter', -15 FROM dfq WHERE length(term) = 1) GROUP BY 1, 2""")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule moved a score."""
    r = _counts(spark, sf_dir).select(F.explode_outer(D.reasons(F.col("term"), F.col("cf"), F.col("df"))).alias("r")).where("r is not null")
    return r.select("r.*").groupBy("reason", "points").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS name, 'documents' AS corpus FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), 'pages' FROM pages),
          c AS (SELECT name FROM u GROUP BY 1 HAVING count(DISTINCT corpus) > 1)
          SELECT CASE WHEN name IN (SELECT name FROM c) THEN corpus || '_' || name ELSE name END AS name, corpus FROM u""")
def combine_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return D.combined([("documents", table(spark, sf_dir, "documents")), ("pages", pages)])


@query("SELECT r_name, count(DISTINCT n_nationkey) AS n_nations, count(DISTINCT c_custkey) AS n_customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def country_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    r = table(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return r.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("n_nations"), F.countDistinct("c_custkey").alias("n_customers"))


@query(f"WITH {DF} SELECT term, round(log10(df + 1) / log10(333001.0), 8) AS rarity FROM dfq")
def log_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("term", F.round(O.log_rarity(F.col("df")), 8).alias("rarity"))


@query("""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM benchmark UNION SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) FROM part)
          SELECT substr(term, 1, 1) AS letter, count(*) AS n FROM w GROUP BY 1""")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two word lists, counted by first letter."""
    a = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term"))
    b = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    w = a.union(b).select(F.lower("term").alias("term")).distinct()
    return w.groupBy(F.substring("term", 1, 1).alias("letter")).agg(F.count("*").alias("n"))


@query()
def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = D.choose_k(table(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(k,)], "k int")


@query("""SELECT doc_id, bit_count_caps AS n_caps, n_digits FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS bit_count_caps, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS n_digits FROM documents)""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("[A-Z]").alias("n_caps"), count("[0-9]").alias("n_digits"))
