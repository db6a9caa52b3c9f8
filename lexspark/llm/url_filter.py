"""URL filter: hash-prefix lookup of host-suffix and path-prefix expressions.

Each URL is expanded into expressions ``host suffix + path prefix``.  Only the
suffix lengths (in labels) and prefix lengths (in characters) that occur in the
rules are made, so any rule that can fit is found and a very long URL stays
cheap.  Distinct expressions meet the rules on the first 32 bits of their
SHA-256; a hit counts when all 256 bits agree.  The longest rule wins; of equal
length, the one with the longer host, then ``block`` before ``allow``.

Null URLs and URLs without ``://`` have an empty host and path: no rule fits
them and they get the default verdict.  Repeated rows stay, each with its own
verdict.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Hexadecimal digits of the short hash: 32 bits.
SHORT = 8
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def prepared(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with their expression, digest, short hash and shape."""
    r = rules.select(lower_ascii("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    r = r.where("rule_host <> ''").withColumn("rule", F.concat("rule_host", "rule_path"))
    return r.withColumns({
        "digest": F.sha2("rule", 256),
        "labels": F.size(F.split("rule_host", "\\.")),
        "path_chars": F.length("rule_path"),
    }).withColumn("short", F.substring("digest", 1, SHORT))


def expanded(hosts: DataFrame, labels: list[int], path_chars: list[int]) -> DataFrame:
    """A row for each expression of (host, path)."""
    suffixes = F.transform(F.array(*map(F.lit, labels)), lambda k: F.when(F.size("parts") >= k, F.array_join(F.slice("parts", F.size("parts") - k + 1, k), ".")))
    prefixes = F.transform(F.array(*map(F.lit, path_chars)), lambda k: F.when(F.length("path") >= k, F.substring("path", F.lit(1), k)))
    both = hosts.withColumn("parts", F.split("host", "\\.")).withColumns({"suffix": F.array_compact(suffixes), "prefix": F.array_compact(prefixes)})
    return both.select("host", "path", F.explode("suffix").alias("suffix"), "prefix").select("host", "path", "suffix", F.explode("prefix").alias("prefix")).select("host", "path", F.concat("suffix", "prefix").alias("expression"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict for each row of pages.

    The distinct shapes of the rules are the one thing that comes to the
    driver; they are bounded by the length of a URL.
    """
    parsed = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    r = prepared(rules)
    labels = sorted(x[0] for x in r.select("labels").distinct().collect())
    chars = sorted(x[0] for x in r.select("path_chars").distinct().collect())
    if not labels:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # One row for each different URL, so a host with a third of the rows is expanded once for each of its paths.
    every = expanded(parsed.where("host <> ''").select("host", "path").distinct(), labels, chars)
    asked = every.select("expression").distinct().withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, SHORT))
    hits = asked.join(r, "short").where("full = digest").select("expression", "rule", "rule_host", "rule_verdict")
    rank = F.struct(F.length("rule"), F.length("rule_host"), "rule_verdict")
    best = every.join(stored(hits, "url-hits"), "expression").groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), rank).alias("best"))
    best = stored(best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("found")), "url-best")
    out = parsed.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
