"""What the query modules share: table access, the registry, and SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import STOPWORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """A text as a literal of SQL, line ends and form feeds spelt out."""
    t = "'" + text.replace("'", "''") + "'"
    for char, code in (("\n", 10), ("\f", 12)):
        t = t.replace(char, f"' || chr({code}) || '")
    return f"({t})" if "chr(" in t else t


def registry():
    """(queries, oracle, decorator): the decorator registers a query under its name, with its SQL."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


#: SQL for all_tokens() and tokens() of a text.
ALL = r"""list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_''-]+'), lambda x: trim(x, '''-')), lambda x: regexp_full_match(x, '[a-z]([a-z0-9''-]*[a-z0-9])?'))"""
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TOKENS = f"list_filter({ALL}, lambda x: length(x) >= 3 AND NOT list_contains({STOP}, x))"
#: Common table expressions: tok (doc_id, term), tf, dfq (term, df, cf).
TOK = f"tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)"
TF = f"{TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"
DF = f"{TF}, dfq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1), nd AS (SELECT count(*) AS n FROM documents)"
IDF = f"{DF}, idf AS (SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 4) AS idf FROM dfq, nd)"
