"""Queries over terms: from tokens to a scored vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as M
from ..operators import terms as O
from .base import DF, IDF, STOP, TF, TOK, registry, table

QUERIES, ORACLE_SQL, query = registry()


@query(f"WITH {DF} SELECT term, df, cf FROM dfq")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.document_frequency(O.term_frequency(table(spark, sf_dir, "documents")))


@query(f"WITH {IDF} SELECT term, df, idf FROM idf ORDER BY idf, term LIMIT 100")
def idf_common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred terms of least IDF."""
    d = table(spark, sf_dir, "documents")
    df = O.document_frequency(O.term_frequency(d)).crossJoin(F.broadcast(O.corpus_size(d)))
    return O.with_idf(df, F.col("n")).select("term", "df", "idf").orderBy("idf", "term").limit(100)


@query(f"""WITH {IDF}, dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
           s AS (SELECT doc_id, term, tf, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 5000.0)), 6) AS score FROM tf JOIN idf USING (term) JOIN dl USING (doc_id))
           SELECT doc_id, term, tf, score, least(score / 15, 1.0) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s WHERE score >= 2.0) WHERE rank <= 100""")
def corpus_bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.corpus_bm25(table(spark, sf_dir, "documents"))


@query(f"WITH {DF} SELECT term, df FROM dfq, nd WHERE n >= 5 AND df >= 5 AND df / n >= 0.2")
def corpus_common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    df = O.document_frequency(O.term_frequency(d)).crossJoin(F.broadcast(O.corpus_size(d)))
    return df.where("n >= 5 and df >= 5 and df / n >= 0.2").select("term", "df")


@query(f"WITH {DF} SELECT term, cf AS n, row_number() OVER (ORDER BY cf DESC, term) - 1 AS rank, round((row_number() OVER (ORDER BY cf DESC, term) - 1) / count(*) OVER (), 8) AS percentile FROM dfq")
def word_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = O.document_frequency(O.term_frequency(table(spark, sf_dir, "documents")))
    return O.percentile_rank(df.select("term", F.col("cf").alias("n")))


#: Occurrences by source, each source with a confidence from its mean length.
_SOURCES = f"""{TOK}, c AS (SELECT source, round(least(0.99, 0.5 + avg(n_chars) / 10000.0), 3) AS confidence FROM documents GROUP BY 1),
    o AS (SELECT term, source, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY 1, 2), s AS (SELECT * FROM o JOIN c USING (source))"""


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = d.groupBy("source").agg(F.round(F.least(F.lit(0.99), 0.5 + F.avg("n_chars") / 10000.0), 3).alias("confidence"))
    o = d.select("source", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "source").agg(F.count("*").alias("n"))
    return o.join(F.broadcast(c), "source")


@query(f"""WITH {_SOURCES} SELECT term, CAST(sum(n) AS BIGINT) AS total, round(sum(confidence * n) / sum(n), 9) AS mean, round(min(confidence), 9) AS least, round(max(confidence), 9) AS most,
           round(coalesce(stddev_pop(confidence), 0), 9) AS spread, round(avg(CASE WHEN confidence > 0.8 THEN 1.0 ELSE 0.0 END), 9) AS high_ratio, bool_and(confidence < 0.6) AS all_low, round(pow(sum(confidence * n), 1.1), 4) AS weighted
           FROM s GROUP BY term""")
def term_sources_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_stats(_by_source(spark, sf_dir))


@query(f"""WITH {_SOURCES}, w AS (SELECT term, round(pow(sum(confidence * n), 1.1), 4) AS weighted FROM s GROUP BY 1) SELECT term, weighted FROM w ORDER BY weighted DESC, term LIMIT 200""")
def weighted_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.source_stats(_by_source(spark, sf_dir)).select("term", "weighted").orderBy(F.desc("weighted"), "term").limit(200)


#: Candidates of two simple extractors: words with a capital, and long words.
_CAND = r"""w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z]+')) AS t FROM documents),
    cand AS (SELECT t AS term, 'CAPS' AS algorithm, 0.9 AS confidence, 'Person' AS type, count(*) AS frequency FROM w WHERE regexp_matches(t, '^[A-Z]') GROUP BY 1
             UNION ALL SELECT t, 'LONG', 0.6, 'Technical', count(*) FROM w WHERE length(t) >= 8 GROUP BY 1)"""
_MERGED = f"""{_CAND}, g AS (SELECT lower(trim(term)) AS key, * FROM cand),
    f AS (SELECT key, term, sum(frequency) AS n, CAST(term <> lower(term) AND term <> upper(term) AS INTEGER) AS mixed FROM g GROUP BY 1, 2),
    m AS (SELECT key, CAST(sum(frequency) AS BIGINT) AS frequency, count(DISTINCT algorithm) AS n_algorithms, round(sum(confidence * weight) / sum(weight), 6) AS confidence, arg_max(type, prec) AS type
          FROM (SELECT *, CASE algorithm WHEN 'CAPS' THEN 1.0 ELSE 0.7 END AS weight, CASE type WHEN 'Person' THEN 9 ELSE 1 END AS prec FROM g) GROUP BY 1),
    x AS (SELECT key, arg_max(term, (n, mixed, term)) AS term FROM f GROUP BY 1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z]+"), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))
    make = lambda df, a, c, t: df.select("term", F.lit(a).alias("algorithm"), F.lit(c).alias("confidence"), F.lit(t).alias("type"), "frequency")
    return make(w.where(F.col("term").rlike("^[A-Z]")), "CAPS", 0.9, "Person").unionByName(make(w.where(F.length("term") >= 8), "LONG", 0.6, "Technical"))


_WEIGHTS = {"CAPS": 1.0, "LONG": 0.7}


@query(f"WITH {_MERGED} SELECT key, frequency, n_algorithms, confidence, type FROM m")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged(_candidates(spark, sf_dir), _WEIGHTS).drop("term")


@query(f"WITH {_MERGED} SELECT type, count(*) AS n_terms, CAST(sum(frequency) AS BIGINT) AS frequency FROM m GROUP BY 1")
def type_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged(_candidates(spark, sf_dir), _WEIGHTS).groupBy("type").agg(F.count("*").alias("n_terms"), F.sum("frequency").alias("frequency"))


@query(f"WITH {_MERGED} SELECT key, term FROM x")
def canonical_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged(_candidates(spark, sf_dir), _WEIGHTS).select("key", "term")


@query(f"""WITH {TF} SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most, arg_max(lang, (tf, -tf.doc_id)) AS main_lang, count(DISTINCT lang) AS n_langs, bool_or(source = 'src0') AS in_src0
           FROM tf JOIN documents ON tf.doc_id = documents.doc_id GROUP BY term""")
def multi_doc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = O.term_frequency(d).join(d.select("doc_id", "lang", "source"), "doc_id")
    return t.groupBy("term").agg(
        F.count("*").alias("n_docs"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"), F.max_by("lang", F.struct("tf", -F.col("doc_id"))).alias("main_lang"),
        F.countDistinct("lang").alias("n_langs"), F.bool_or(F.col("source") == "src0").alias("in_src0"),
    )


_SCORED = f"""{_SOURCES}, g AS (SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs, sum(confidence * n) / sum(n) AS mean, avg(CASE WHEN confidence > 0.8 THEN 1.0 ELSE 0.0 END) AS high, bool_and(confidence < 0.6) AS low FROM s GROUP BY 1),
    q AS (SELECT *, greatest(0.0, least(100.0, round(50 + least(18 * log10(total + 1), 35.0) + 20 + (CASE WHEN docs >= 2 THEN 10 ELSE 0 END) + (CASE WHEN high > 0.8 THEN 5 ELSE 0 END) - (CASE WHEN low THEN 10 ELSE 0 END)
             - (CASE WHEN docs = 1 AND mean < 0.7 THEN 10 ELSE 0 END), 1))) AS score FROM g)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.source_stats(_by_source(spark, sf_dir), exact=True)
    none = F.lit(0)
    score = O.quality_score(F.lit(False), F.col("total"), none, F.lit(1), F.col("term"), F.col("docs"), F.lit(20), F.col("mean"), F.col("high_ratio"), F.col("all_low"), F.lit(0.0))
    return s.withColumn("score", score)


@query(f"WITH {_SCORED} SELECT term, total, docs, score FROM q")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("term", "total", "docs", "score")


@query(f"""WITH {_SCORED} SELECT CASE WHEN total > 1000 THEN 'too frequent' WHEN total < 2 AND score < 97 THEN 'below min occurrences' ELSE 'kept' END AS gate, count(*) AS n FROM q GROUP BY 1""")
def occurrence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = F.when(F.col("total") > 1000, "too frequent").when((F.col("total") < 2) & (F.col("score") < 97), "below min occurrences").otherwise("kept")
    return _scored(spark, sf_dir).groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SCORED} SELECT term, total, score FROM q WHERE score >= 90 AND contains(term, 'tion') ORDER BY score DESC, term LIMIT 50""")
def display_sort_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a vocabulary: over the score floor, with a text filter, best first."""
    return _scored(spark, sf_dir).where("score >= 90 and contains(term, 'tion')").select("term", "total", "score").orderBy(F.desc("score"), "term").limit(50)


@query(f"WITH {DF}, ex AS (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION SELECT unnest({STOP})) SELECT term, cf FROM dfq WHERE term NOT IN (SELECT term FROM ex)")
def exclude_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = O.document_frequency(O.term_frequency(table(spark, sf_dir, "documents")))
    ex = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    return df.join(ex.distinct(), "term", "left_anti").select("term", "cf")


@query(f"""WITH {_SCORED}, good AS (SELECT term FROM q WHERE score >= 90), e AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS term FROM benchmark)
           SELECT item_id, 3 * count(*) AS points FROM e JOIN good USING (term) GROUP BY 1""")
def excerpt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points for each good term that an excerpt holds."""
    good = _scored(spark, sf_dir).where("score >= 90").select("term")
    e = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term"))
    return e.join(good, "term").groupBy("item_id").agg((3 * F.count("*")).alias("points"))


@query()
def rake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rake(table(spark, sf_dir, "documents"))


@query()
def yake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.yake(table(spark, sf_dir, "documents"))


@query()
def topicrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.topicrank(table(spark, sf_dir, "documents"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{2,6}\b')) AS term FROM documents WHERE regexp_full_match(text, '[\x00-\x7F]*')""")
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of the texts in ASCII, where word boundaries mean the same everywhere."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z"))
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(O.ACRONYM), F.lit(0))).alias("term"))


@query()
def acronyms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of all texts, between boundaries of a fixed class; acronyms, whose SQL has word boundaries, takes the texts in ASCII only."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(O.BOUNDED_ACRONYM), F.lit(0))).alias("term"))


@query()
def ner_rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.entities(table(spark, sf_dir, "documents"))


@query()
def gibberish_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean surprise of a word's letter pairs, learned from the corpus."""
    return M.gibberish(table(spark, sf_dir, "documents"))


@query(f"""WITH {TF}, r AS (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM tf)
           SELECT doc_id, term, tf FROM r WHERE rank <= least(floor(0.75 * n), greatest(10, floor(0.25 * n)))""")
def top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest quarter of each document's terms, ten at least, three quarters at most."""
    w = Window.partitionBy("doc_id")
    r = O.term_frequency(table(spark, sf_dir, "documents")).withColumns({"rank": F.row_number().over(w.orderBy(F.desc("tf"), "term")), "n": F.count("*").over(w)})
    return r.where("rank <= least(floor(0.75 * n), greatest(10, floor(0.25 * n)))").select("doc_id", "term", "tf")
