"""Secret scan with multipart credential linking.

Base kinds (assign, access, hex) are always reported.  Weak candidates are
collected beside them: identifiers (``client_id = x``), secrets without a tell
(40 characters of base64, ``pwd: x``) and endpoints.  A weak candidate counts
only when complementary parts lie within ``scope`` code points of it:

* a weak secret needs an identifier or an endpoint,
* an identifier needs a secret,
* an endpoint needs an identifier and a secret.

The interval join runs over cells of ``scope`` code points: each part covers the
cells that it touches, each cell keeps the first start and the last end of a
role, and a candidate meets the cells within reach.  As cells are as wide as the
scope, those two numbers decide exactly, and no pairs of parts are made.  No
Python runs on executors.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.  A
very long text is one row of spans.  Columns of any name pass through.
Weak candidates that overlap a base span are dropped, as that is reported.
Repeated rows are reported each; rows link only within their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import neutral, stored

SCOPE = 256
#: The kinds in order of listing, base kinds first.
KINDS = ["assign", "access", "hex", "ident", "weak", "endpoint"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
IDENT = r"""(?i)(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
WEAK = r"""(?i)(?<![A-Za-z0-9])(?:pwd|pass|passphrase|private_?key|auth|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"""
ENDPOINT = r"""(?i)(?<![A-Za-z0-9])(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]+"""
#: Literals of which a text needs one before the pattern is tried, in lower case.
ASKS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "ident": ["keyid", "key_id", "clientid", "client_id", "accountid", "account_id", "username", "user_name", "login"],
    "endpoint": ["://"],
}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(kind: str, text: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost, non-overlapping matches: ends follow from the lengths of what lies between them."""
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    rest = F.split(F.col(text), pattern, -1)
    size = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if least else whole
    steps = F.zip_with(F.zip_with(rest, whole, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n"))), size, lambda a, b: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), F.length(b).alias("size")))
    steps = F.filter(steps, lambda x: x["n"].isNotNull())
    k = KINDS.index(kind)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + x["n"]).alias("end")))
        return F.struct((start + x["n"]).alias("at"), F.when(x["size"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, begin, add, lambda acc: acc["out"])
    ask = F.lit(True)
    if kind in ASKS:
        low = F.lower(F.col(text))
        ask = F.lit(False)
        for x in ASKS[kind]:
            ask = ask | low.contains(x)
    return F.when(ask & F.col(text).rlike(pattern), found).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with s_key, s_base and s_weak: the base spans and the weak candidates of each text."""
    d = docs.withColumn("s_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = d.withColumn("s_key", F.struct(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.xxhash64("s_text").alias("hash")))
    d = d.withColumns({
        "s_assign": _spans("assign", "s_text", ASSIGN, 2, 6),
        "s_access": _spans("access", "s_text", ACCESS),
        "s_hex": _spans("hex", "s_text", HEX),
        "s_ident": _spans("ident", "s_text", IDENT),
        "s_endpoint": _spans("endpoint", "s_text", ENDPOINT),
        "s_weak": _spans("weak", "s_text", WEAK),
    })
    d = d.withColumns({"s_base": F.sort_array(F.concat("s_assign", "s_access", "s_hex")), "s_weak": F.concat("s_ident", "s_weak", "s_endpoint")})
    clear = F.filter("s_weak", lambda w: ~F.exists("s_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return d.withColumn("s_weak", F.when(F.size("s_weak") > 0, clear).otherwise(F.col("s_weak"))).drop("s_text", "s_assign", "s_access", "s_hex", "s_ident", "s_endpoint")


def _role(kind: Column) -> Column:
    """0: identifier, 1: secret, 2: endpoint."""
    return F.when(kind.isin(KINDS.index("access"), KINDS.index("ident")), 0).when(kind == KINDS.index("endpoint"), 2).otherwise(1)


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(s_key, s_more): the weak candidates with complementary parts in scope. found: s_key, s_base, s_weak."""
    some = found.where(F.size("s_weak") > 0).where(F.size("s_weak") + F.size("s_base") > 1)
    parts = some.select("s_key", F.explode(F.concat("s_base", "s_weak")).alias("p")).select("s_key", "p.*").distinct().withColumn("role", _role(F.col("kind")))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))))
    cells = stored(cells.groupBy("s_key", "cell", "role").agg(F.min("start").alias("first"), F.max("end").alias("last")), "secret-cells")
    weak = parts.where(F.col("kind") >= KINDS.index("ident"))
    near = weak.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    met = near.join(cells.withColumnRenamed("role", "other"), ["s_key", "cell"]).where((F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope))
    has = lambda r: F.max((F.col("other") == r).cast("int")) == 1
    sets = met.groupBy("s_key", "start", "kind", "end", "role").agg(has(0).alias("i"), has(1).alias("s"), has(2).alias("e"))
    kept = sets.where(((F.col("role") == 1) & (F.col("i") | F.col("e"))) | ((F.col("role") == 0) & F.col("s")) | ((F.col("role") == 2) & F.col("i") & F.col("s")))
    # The list of one text's spans: bounded by that text.
    return kept.groupBy("s_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("s_more"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""
    found = stored(scanned(docs, text, key).select(F.col(key).alias("s_doc"), "s_key", "s_base", "s_weak"), "secret-spans")
    out = found.join(stored(linked(found, scope), "secret-links"), "s_key", "left")
    every = F.sort_array(F.concat("s_base", F.coalesce("s_more", F.array().cast(SPAN))))
    count = lambda k: F.size(F.filter("s_base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return out.select(F.col("s_doc").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(written(F.col("s_base")), 256).alias("base_sha256"), written(every).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", key: str = "doc_id", mask: str = "[SECRET]", scope: int = SCOPE, count: str | None = None) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by mask; column count, if named, gets the new length. Others stay."""
    kind = docs.schema[count].dataType if count else None
    docs, (text, key, count), back = neutral(docs, text, key, count)
    found = scanned(docs, text, key)
    out = found.join(stored(linked(stored(found.select("s_key", "s_base", "s_weak"), "secret-spans"), scope), "secret-links"), "s_key", "left")
    out = out.withColumn("s_all", F.sort_array(F.concat("s_base", F.coalesce("s_more", F.array().cast(SPAN)))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("s_all", begin, add, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    masked = F.size("s_all") > 0
    out = out.withColumn(text, F.when(masked, clean).otherwise(F.col(text)))
    if count:
        out = out.withColumn(count, F.when(masked, F.length(text).cast(kind)).otherwise(F.col(count)))
    return back(out)
