"""Queries over the cleaning stages.

The tables hold no scanned documents, so where a stage needs an artefact, query
and SQL first put the same one in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from .base import ALL, TOK, quoted, registry, table

QUERIES, ORACLE_SQL, query = registry()


@query(f"SELECT lang, CAST(sum(len({ALL})) AS BIGINT) AS n_tokens, count(*) AS n_docs FROM documents GROUP BY lang")
def token_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(F.size(T.all_tokens(F.col("text")))).alias("n_tokens"), F.count("*").alias("n_docs"))


@query(r"""SELECT doc_id, md5(regexp_replace(t, '(\w+)-\s*\n\s*(\w+)', '\1\2', 'g')) AS digest FROM
           (SELECT doc_id, regexp_replace(coalesce(text, ''), '([a-z]{3})([a-z]{3}) ', '\1-' || chr(10) || ' \2 ', 'g') AS t FROM documents)""")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z]{3})([a-z]{3}) ", "$1-\n $2 "))
    return d.select("doc_id", F.md5(T.dehyphenated(F.col("t"))).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || ' ' || chr(10) || chr(10) || chr(10)), '\n[ \t]*(\n[ \t]*){2,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def collapse_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n \n\n\n"))
    return d.select("doc_id", F.md5(T.collapsed(t)).alias("digest"))


@query(f"""SELECT doc_id, count(*) FILTER (length(l) >= 3 AND l = upper(l) AND l <> lower(l)) AS n_caps,
           count(*) FILTER (l = upper(l) AND length(l) < 50 AND regexp_matches(l, '{"|".join(T.LEGAL_WORDS)}')) AS n_headers
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def capital_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n"))
    caps = F.filter("l", lambda x: (F.length(x) >= 3) & (x == F.upper(x)) & (x != F.lower(x)))
    return d.where("text is not null").select("doc_id", F.size(caps).cast("long").alias("n_caps"), F.size(F.filter("l", T.is_legal_header)).cast("long").alias("n_headers"))


@query(r"""SELECT doc_id, count(*) FILTER (regexp_matches(l, '(?i)^\s*(page\s+\d+(\s+of\s+\d+)?|[-–]\s*\d+\s*[-–]|\d{1,4}|pg?\.?\s*\d+|\d+/\d+)\s*$')) AS n_removed, count(*) AS n_lines
           FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || 'Page ' || doc_id || chr(10)), chr(10))) AS l FROM documents) GROUP BY doc_id""")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit(". "), F.concat(F.lit("\nPage "), F.col("doc_id").cast("string"), F.lit("\n")))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.alias("t"))
    n = F.size(F.split("t", "\n")).cast("long")
    kept = F.size(F.filter(F.split("t", "\n"), lambda x: ~x.rlike(T.PAGE_NUMBER)))
    return d.select("doc_id", (n - kept).alias("n_removed"), n.alias("n_lines"))


@query(r"""SELECT doc_id, count(*) FILTER (regexp_matches(l, '[A-Za-z]+\s*\(\d+\)') OR len(regexp_extract_all(l, '\d{2,4}:\d{1,2}')) >= 2) AS n_index, count(*) AS n_lines
           FROM (SELECT doc_id, unnest(string_split(replace(text, ', ', ' (12)' || chr(10)), chr(10))) AS l FROM documents) GROUP BY doc_id""")
def index_line_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split(F.replace("text", F.lit(", "), F.lit(" (12)\n")), "\n").alias("l"))
    return d.select("doc_id", F.size(F.filter("l", T.is_index_line)).cast("long").alias("n_index"), F.size("l").cast("long").alias("n_lines"))


_SCORE = " + ".join(f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN {w} ELSE 0 END" for p, w in T.TITLE_SIGNS)


@query(rf"""SELECT page_id, s + CASE WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 500 AND s > 0 THEN 1 ELSE 0 END AS score FROM
           (SELECT page_id, t, {_SCORE} AS s FROM (SELECT page_id, coalesce(html, '') || CASE WHEN page_id % 3 = 0 THEN ' SUPREME COURT Index No. 7 Plaintiff, ' ELSE '' END AS t FROM pages))""")
def title_page_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    t = F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 3 == 0, " SUPREME COURT Index No. 7 Plaintiff, ").otherwise(""))
    return p.select("page_id", T.title_score(t).alias("score"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
           f AS (SELECT doc_id, lower(regexp_replace(regexp_replace(trim(line), '\s*-?\s*\d+\s*-?\s*$', ''), '\s+', ' ', 'g')) AS form FROM l)
           SELECT doc_id, form, count(*) AS n FROM f WHERE form <> '' GROUP BY 1, 2 HAVING count(*) >= 3""")
def header_footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat within a document, as its running headers do."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))  # noqa: E741
    return l.withColumn("form", T.header_form(F.col("line"))).where("form <> ''").groupBy("doc_id", "form").agg(F.count("*").alias("n")).where("n >= 3")


@query(r"""SELECT doc_id, len(list_distinct(list_concat(regexp_extract_all(t, '(?i)Case\s+No\.?\s*:?\s*\d+:\d+-\w+-\d+'), regexp_extract_all(t, '(?i)Index\s+No\.?\s*:?\s*\d+/\d{4}'),
           regexp_extract_all(t, '(?i)Docket\s+No\.?\s*:?\s*\d+-\d+'), regexp_extract_all(t, '(?i)Case\s+No\.?\s*:?\s*\d+')))) AS n_numbers, regexp_extract(t, '(?i)Index\s+No\.?\s*:?\s*\d+/\d{4}') AS index_number
           FROM (SELECT doc_id, coalesce(text, '') || ' Case No. 1:23-cv-' || doc_id || ', Index No. ' || doc_id || '/2024, case no: 77' AS t FROM documents)""")
def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" Case No. 1:23-cv-"), k, F.lit(", Index No. "), k, F.lit("/2024, case no: 77"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.size(T.case_numbers(F.col("t"))).cast("long").alias("n_numbers"), F.regexp_extract("t", T.CASE_NUMBERS[1], 0).alias("index_number"))


@query(r"""SELECT doc_id, md5(regexp_replace(t, '[█▓▒]{2,}', ' [REDACTED] ', 'g')) AS digest, len(regexp_extract_all(t, '[█▓▒]')) AS n_glyphs
           FROM (SELECT doc_id, replace(coalesce(text, ''), 'the', '██▓') AS t FROM documents)""")
def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("the"), F.lit("██▓")).alias("t"))
    return d.select("doc_id", F.md5(T.redacted(F.col("t"))).alias("digest"), F.regexp_count("t", F.lit("[█▓▒]")).cast("long").alias("n_glyphs"))


@query()
def sanitised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.sanitised(T.normalised(F.col("text"))).alias("text"))


@query()
def line_number_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i % 25 + 1).cast("string"), F.lit("    "), x)), "\n")
    return d.select("doc_id", T.without_line_numbers(numbered).alias("text"))


@query(f"""WITH {TOK}, f AS (SELECT term, count(*) AS n FROM tok GROUP BY 1),
           w AS (SELECT doc_id, unnest({ALL}) AS term FROM documents)
           SELECT doc_id, round(100.0 * avg(CASE WHEN n >= 50 THEN 1.0 WHEN n >= 5 THEN 0.5 ELSE 0.0 END), 6) AS confidence FROM w LEFT JOIN f USING (term) GROUP BY doc_id""")
def dictionary_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a document are known words: 1 for common, one half for fair, 0 for others, of 100."""
    d = table(spark, sf_dir, "documents")
    f = d.select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # Counted by document first: a word that is common in all texts is a row for each text, not for each use.
    w = d.select("doc_id", F.explode(T.all_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("k"))
    value = F.when(F.col("n") >= 50, 1.0).when(F.col("n") >= 5, 0.5).otherwise(0.0)
    return w.join(f, "term", "left").groupBy("doc_id").agg(F.round(100.0 * F.sum(value * F.col("k")) / F.sum("k"), 6).alias("confidence"))


@query(rf"""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (regexp_matches(t, '(?im)^\s*MR\.\s+\w+\s*:')) AS n_marked, CAST(sum(length(regexp_replace(t, '{T.SPEAKER}', chr(10) || chr(10) || '\1', 'g'))) AS BIGINT) AS n_chars
           FROM (SELECT conv_id, CASE role WHEN 'user' THEN 'MR. SMITH: ' WHEN 'assistant' THEN 'THE WITNESS: ' ELSE '' END || coalesce(text, '') AS t FROM conversations) GROUP BY conv_id""")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.concat(F.when(F.col("role") == "user", "MR. SMITH: ").when(F.col("role") == "assistant", "THE WITNESS: ").otherwise(""), F.coalesce("text", F.lit("")))
    c = c.select("conv_id", t.alias("t"))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("t").rlike(r"(?im)^\s*MR\.\s+\w+\s*:")).alias("n_marked"), F.sum(F.length(T.speaker_boundaries(F.col("t")))).alias("n_chars"))


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(table(spark, sf_dir, "documents"))


@query()
def paginate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, CAST(s AS BIGINT) AS start, substr(text, s + 1, 500) AS part FROM
          (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 250)) AS s FROM documents WHERE text IS NOT NULL)""")
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.windows(table(spark, sf_dir, "documents"), 500)


@query("""SELECT item_id, CAST(p AS BIGINT) AS pos FROM (SELECT item_id, lower(text) AS t, unnest(range(0, length(text) - 1)) AS p FROM benchmark) WHERE substr(t, p + 1, 2) = 'th'""")
def find_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlapping places of a word, without regard to case."""
    return C.positions(table(spark, sf_dir, "benchmark"), "th", "item_id")


@query()
def html_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    return p.select("page_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias("tf"))
