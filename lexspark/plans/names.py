"""Queries over names and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import names as N
from ..operators import terms as O
from .base import TOK, registry, table

QUERIES, ORACLE_SQL, query = registry()
#: Two-word part names, and single words from their brands, with counts.
TERMS = "terms AS (SELECT term, count(*) AS n FROM (SELECT p_name AS term FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part WHERE p_size <= 10 UNION ALL SELECT lower(p_type) FROM part) GROUP BY 1)"
WORDS = "tw AS (SELECT term, n, list_sort(list_distinct(regexp_split_to_array(lower(trim(term)), '\\s+'))) AS w FROM terms)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_name").alias("term")).union(p.where("p_size <= 10").select(F.split("p_name", " ")[0])).union(p.select(F.lower("p_type")))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {TERMS}, {WORDS} SELECT array_to_string(w, ' ') AS name_key, arg_max(term, (n, term)) AS term, count(*) AS n_forms, CAST(sum(n) AS BIGINT) AS total FROM tw GROUP BY 1")
def reversed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.reversed_names(_terms(spark, sf_dir))


@query(f"WITH {TERMS}, {WORDS} SELECT a.term, min(b.term) AS whole FROM tw a JOIN tw b ON len(a.w) < len(b.w) AND list_has_all(b.w, a.w) GROUP BY 1")
def fragment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fragments(_terms(spark, sf_dir))


@query(f"""WITH {TERMS}, {WORDS}, f AS (SELECT term AS full_name, n AS fn, unnest(w) AS x FROM tw WHERE len(w) > 1), o AS (SELECT x, min(full_name) AS full_name, min(fn) AS fn FROM f GROUP BY x HAVING count(*) = 1)
           SELECT term, full_name, n, n + fn AS total FROM tw JOIN o ON len(w) = 1 AND w[1] = x""")
def single_word_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.absorbed(_terms(spark, sf_dir))


@query(f"WITH {TERMS}, p AS (SELECT regexp_split_to_array(lower(trim(term)), '\\s+') AS p FROM terms) SELECT p[len(p)] AS last_name, count(DISTINCT p[1]) AS n_first FROM p WHERE len(p) >= 2 GROUP BY 1 HAVING count(DISTINCT p[1]) >= 2")
def shared_last_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.shared_last_names(_terms(spark, sf_dir))


@query(f"WITH {TERMS}, {WORDS}, parts AS (SELECT DISTINCT unnest(w) AS x FROM tw WHERE len(w) > 1) SELECT term, n FROM tw WHERE NOT (len(w) = 1 AND w[1] IN (SELECT x FROM parts))")
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.component_names(_terms(spark, sf_dir))


@query(f"WITH {TERMS}, best AS (SELECT lower(term) AS c FROM terms WHERE contains(term, ' ') ORDER BY n DESC, term LIMIT 25) SELECT term, n FROM terms WHERE NOT EXISTS (SELECT 1 FROM best WHERE contains(lower(term), c) AND lower(term) <> c)")
def substring_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.substring_artifacts(_terms(spark, sf_dir))


@query(f"""WITH {TOK}, t AS (SELECT term, count(*) AS n FROM tok GROUP BY 1 HAVING length(term) >= 5)
           SELECT a.term, b.term AS canonical, b.n AS canonical_n, levenshtein(a.term, b.term) AS distance FROM t a JOIN t b
           ON a.n * 10 <= b.n AND abs(length(a.term) - length(b.term)) <= 2 AND levenshtein(a.term, b.term) <= 2""")
def typo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return N.typo_pairs(d.select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")))


@query()
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.similar_names(_terms(spark, sf_dir))


@query("""WITH x AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'plaintiff' WHEN 'assistant' THEN 'witness' ELSE 'defendant' END AS r, 'Person ' || chr(CAST(65 + conv_id % 26 AS INTEGER)) || 'x' AS p FROM conversations)
          SELECT p AS person, arg_min(CASE r WHEN 'plaintiff' THEN 'Plaintiff' WHEN 'defendant' THEN 'Defendant' ELSE 'Witness' END, CASE r WHEN 'plaintiff' THEN 1 WHEN 'defendant' THEN 2 ELSE 4 END) AS role FROM x GROUP BY 1""")
def role_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    person = F.concat(F.lit("Person "), F.char((65 + F.col("conv_id") % 26).cast("int")), F.lit("x"))
    word = F.when(F.col("role") == "user", "plaintiff").when(F.col("role") == "assistant", "witness").otherwise("defendant")
    c = c.select(person.alias("person"), F.concat(F.lit("said "), word, F.lit(" "), person, F.lit(".")).alias("text"))
    return N.roles(c, c)


_RANKS = """counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part) GROUP BY 1),
    ranks AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS rank, round((row_number() OVER (ORDER BY n DESC, term) - 1) / count(*) OVER (), 8) AS percentile FROM counts)"""
_RARITY = f"""{_RANKS}, w AS (SELECT DISTINCT p_name AS phrase FROM part), u AS (SELECT phrase, unnest(string_split(lower(phrase), ' ')) AS term FROM w),
    s AS (SELECT phrase, coalesce(percentile, 0.85) AS s FROM u LEFT JOIN ranks USING (term)),
    r AS (SELECT phrase, min(s) AS least, max(s) AS most, round(coalesce(avg(s) FILTER (s >= 0.1), avg(s), 0), 6) AS mean, CAST(count(*) AS INTEGER) AS n_words FROM s GROUP BY 1)"""


def _rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    counts = p.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return O.phrase_rarity(p.select(F.col("p_name").alias("phrase")), O.percentile_rank(counts))


@query(f"WITH {_RARITY} SELECT * FROM r")
def phrase_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rarity(spark, sf_dir)


@query(f"WITH {_RARITY} SELECT phrase FROM r WHERE NOT (least < 0.5 OR mean < 0.4)")
def common_phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rarity(spark, sf_dir).where(~O.is_common_phrase()).select("phrase")
