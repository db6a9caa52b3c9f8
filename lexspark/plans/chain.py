"""Queries over the preprocessing chain, each stage on texts that have what it removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import preprocess as P
from .base import quoted, registry, table

QUERIES, ORACLE_SQL, query = registry()
#: SQL for the ends of a text without white space, and the score of a page.
_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _score(page: str) -> str:
    points = " + ".join(f"CASE WHEN regexp_matches({page}, {quoted(p)}) THEN {w} ELSE 0 END" for p, w in T.TITLE_SIGNS)
    return f"({points})"


def _texts(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("t"))


_TITLE = "SUPREME COURT\nIndex No. 12\nPLAINTIFF, against DEFENDANT, \f"
_TITLED = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {quoted(_TITLE)} WHEN 1 THEN {quoted(_TITLE + _TITLE)} ELSE '' END || text || chr(12) || 'the end' AS t FROM documents WHERE text IS NOT NULL"


@query(f"""WITH d AS ({_TITLED}), p AS (SELECT doc_id, length(t) AS n, list_filter(string_split(t, chr(12)), lambda p: {_BARE.format("p")} <> '') AS p FROM d),
    s AS (SELECT *, {_score("p[1]")} AS a, {_score("coalesce(p[2], '')")} AS b, {_score("coalesce(p[3], '')")} AS c, length(p[1]) AS x, length(coalesce(p[2], '')) AS y, length(coalesce(p[3], '')) AS z FROM p),
    k AS (SELECT *, a + CASE WHEN length({_BARE.format("p[1]")}) < 500 AND a > 0 THEN 1 ELSE 0 END >= 4 AND NOT (n > 10000 AND x * 100 > 50 * n) AS one,
                    b + CASE WHEN length({_BARE.format("coalesce(p[2], '')")}) < 500 AND b > 0 THEN 1 ELSE 0 END >= 4 AND NOT (n > 10000 AND (x + y) * 100 > 50 * n) AS two,
                    c + CASE WHEN length({_BARE.format("coalesce(p[3], '')")}) < 500 AND c > 0 THEN 1 ELSE 0 END >= 4 AND NOT (n > 10000 AND (x + y + z) * 100 > 50 * n) AS three FROM s),
    g AS (SELECT doc_id, p, CASE WHEN NOT one THEN 0 WHEN NOT two THEN 1 WHEN NOT three THEN 2 ELSE 3 END AS k FROM k)
    SELECT doc_id, k AS n_removed, md5(array_to_string(p[k + 1:], chr(10) || chr(10))) AS digest FROM g""")
def remove_title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.lit(_TITLE)
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, title).when(F.col("doc_id") % 3 == 1, F.concat(title, title)).otherwise(""), "text", F.lit("\fthe end"))
    d = _texts(spark, sf_dir, t).withColumn("clean", P.without_title_pages(F.col("t")))
    left = F.size(F.split("t", "\f")) - F.size(F.split(F.replace("clean", F.lit("\n\nthe end"), F.lit("\fthe end")), "\f"))
    empty = F.size(F.filter(F.split("t", "\f"), lambda p: P.stripped(p) == ""))
    return d.select("doc_id", (left - empty).alias("n_removed"), F.md5("clean").alias("digest"))


_INDEX = "\n".join(f"morning ({k}) 330:{k},8;331:15" for k in range(1, 13))


@query(f"""WITH d AS (SELECT doc_id, text || chr(12) || CASE WHEN doc_id % 2 = 0 THEN {quoted(_INDEX)} ELSE 'more text' END || chr(12) || 'the end' AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, t, list_filter(string_split(t, chr(12)), lambda p: {_BARE.format("p")} <> '') AS p FROM d),
    l AS (SELECT doc_id, t, p, list_transform(p, lambda x: list_filter(string_split(x, chr(10)), lambda y: {_BARE.format("y")} <> '')) AS l FROM p),
    i AS (SELECT doc_id, t, p, list_transform(l, lambda x: [len(x), len(list_filter(x, lambda y: regexp_matches(y, '[A-Za-z]+\\s*\\(\\d+\\)') OR len(regexp_extract_all(y, '\\d{{2,4}}:\\d{{1,2}}')) >= 2))]) AS i FROM l),
    f AS (SELECT *, list_position(list_transform(i, lambda x: x[2] >= 10 AND x[2] * 100 >= 30 * x[1]), true) AS f FROM i)
    SELECT doc_id, md5(CASE WHEN coalesce(f, 0) > 1 THEN array_to_string(p[:f - 1], chr(10) || chr(10)) ELSE t END) AS digest FROM f""")
def remove_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit("\f"), F.when(F.col("doc_id") % 2 == 0, _INDEX).otherwise("more text"), F.lit("\fthe end"))
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(P.without_index_pages(F.col("t"))).alias("digest"))


_FORM = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s*-?\s*\d+\s*-?\s*$', ''), '\s+', ' ', 'g'))"
_IS_HEADER = f"""({_BARE.format("x")} <> '' AND length({_BARE.format("x")}) <= 120 AND (regexp_matches(x, {quoted(T.any_of(T.HEADER_SIGNS))})
    OR (length({_BARE.format("x")}) <= 70 AND regexp_matches(x, {quoted(T.any_of(T.SHORT_SIGNS))}) AND len(regexp_split_to_array({_BARE.format("x")}, '\\s+')) <= 8 AND NOT regexp_matches({_BARE.format("x")}, '[.?!]$'))))"""


@query(f"""WITH d AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || ' CONFIDENTIAL  draft 7' || chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, l, list_filter(list_transform(l, lambda x: {_FORM.format("x")}), lambda f: f <> '') AS forms, list_transform(list_filter(l, lambda x: {_IS_HEADER}), lambda x: {_FORM.format("x")}) AS looks FROM d),
    g AS (SELECT doc_id, l, list_filter(list_distinct(looks), lambda f: len(list_filter(forms, lambda y: y = f)) >= 3) AS gone FROM f)
    SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT list_contains(gone, {_FORM.format("x")})), chr(10))) AS digest FROM g""")
def remove_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit(". "), F.lit(".\n CONFIDENTIAL  draft 7\n"))
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(P.without_headers(F.col("t"))).alias("digest"))


@query()
def remove_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL's patterns have no look-behind; tested against Python's."""
    t = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i % 25 + 1).cast("string"), F.lit("  "), x)), "\n")
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(T.without_line_numbers(F.col("t"))).alias("digest"))


@query()
def page_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk along the text, tested against planted numbers."""
    t = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(x, F.lit(" sn "), (i + 29).cast("string"), F.lit(" Proceedings "))), " ")
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(P.without_page_boundaries(F.col("t"))).alias("digest"))


@query()
def inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of any letters, which SQL's patterns do not know; tested against Python's."""
    t = F.replace("text", F.lit(", "), F.lit(" (5) 959:14;1003:24 "))
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(P.without_citations(F.col("t"))).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '. ', '.  ' || chr(10) || chr(10) || '   ' || chr(10) || ' '), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)
           SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g')) AS digest FROM d""")
def transcript_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit(". "), F.lit(".  \n\n   \n "))
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(P.single_spaced(F.col("t"))).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, string_split(array_to_string(list_transform(s, lambda x, i: x || chr(10) || CASE WHEN doc_id % 2 = 0 THEN i + 40 ELSE 7 END), chr(10)), chr(10)) AS l FROM d),
    n AS (SELECT doc_id, l, list_filter(list_transform(l, lambda x, i: [CASE WHEN regexp_full_match(x, '\s*\d{1,18}\s*') THEN CAST(regexp_replace(x, '\s', '', 'g') AS BIGINT) END, CAST(i AS BIGINT)]), lambda x: x[1] IS NOT NULL) AS n FROM t),
    o AS (SELECT doc_id, l, list_sort(list_filter(n, lambda x: len(list_filter(n, lambda y: y[1] = x[1])) = 1)) AS o FROM n),
    k AS (SELECT doc_id, l, o, len(o) >= 3 AND len(list_filter(list_transform(o, lambda x, i: i = 1 OR (o[i - 1][2] < x[2] AND x[1] - o[i - 1][1] <= 3)), lambda ok: NOT ok)) = 0 AS ok FROM o)
    SELECT doc_id, md5(array_to_string(CASE WHEN ok THEN list_filter(list_transform(l, lambda x, i: CASE WHEN len(list_filter(o, lambda y: y[2] = i)) = 0 THEN x END), lambda x: x IS NOT NULL) ELSE l END, chr(10))) AS digest FROM k""")
def standalone_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array_join(F.transform(F.split("text", r"\. "), lambda x, i: F.concat(x, F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, i + 41).otherwise(7).cast("string"))), "\n")
    return _texts(spark, sf_dir, t).select("doc_id", F.md5(P.without_standalone_numbers(F.col("t"))).alias("digest"))


@query()
def preprocessed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain as it is set by default."""
    d = P.preprocessed(table(spark, sf_dir, "documents").select("doc_id", "text"), stats="removed")
    return d.select("doc_id", F.md5("text").alias("digest"), F.aggregate(F.map_values("removed"), F.lit(0), lambda a, x: a + x).alias("n_removed"))


@query("""SELECT source, md5(string_agg('--- ' || doc_id || ' ---' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 0 GROUP BY 1""")
def combined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's selection: every tenth document, one text for each source."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 = 0")
    return P.combined(d, "source", "doc_id", "doc_id").select("source", F.md5("text").alias("digest"))
