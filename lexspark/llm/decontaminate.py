"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers turn into <num>, unit words after a number into
<unit>, capitalised words inside a sentence into <name>, all else into lower
case.  Windows of WINDOW template tokens are hashed and joined with those of the
benchmark.  Where they meet, the values behind the placeholders are compared: on
one alignment of document and item, each value of the item must stand for one
and the same value of the document.  A re-parameterised question passes, a
chance meeting of templates does not.  An item counts as leaked into a document
if consistent windows cover half of its tokens or LONG of them.

Benchmark windows are broadcast if they are at most BROADCAST_WINDOWS, else the
join is shuffled.  The template of a window with fewer than LITERALS plain words
says nothing: such a window is hashed with its values and met by verbatim copies
only.  An item shorter than a window is one window of its own length.  No Python
runs on executors.

Null and empty texts hold nothing; an item of fewer than LITERALS tokens cannot
be found, as its copies are chance.  Rows of equal id and text count as one document; a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import neutral, small, stored

WINDOW = 8
LITERALS = 4
LONG = 20
BROADCAST_WINDOWS = 2_000_000
#: Leaking ids are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*|[.!?\n]"
MARKS = [".", "!", "?", "\n"]
#: Words that count as units after a number.
UNITS = (
    "cm centimeter centimeters c day days degree degrees dollar dollars euro euros feet foot ft g gallon gallons gb gram grams "
    "hour hours hr hrs inch inches kb kg kilogram kilograms kilometer kilometers km kmh l lb lbs liter liters m mb meter meters "
    "mg mile miles min mins minute minutes ml mm month months mph ms ounce ounces oz percent pound pounds s sec second seconds "
    "tb ton tons week weeks yard yards year years"
).split()
SLOTS = ["<num>", "<unit>", "<name>"]


def templates(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out, (low, slot) for each template token with its value in the text, and out_h, the hashes of the tokens (odd: plain words)."""
    toks = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))
    df = df.withColumn("t_tok", toks).withColumn("t_low", F.transform("t_tok", lambda t: F.lower(t)))
    digit = lambda t: F.substring(t, 1, 1).between("0", "9")

    def slot(t: Column, i: Column) -> Column:
        before, low = F.get("t_tok", i - 1), F.get("t_low", i)
        name = (t != low) & ((F.length(t) == 1) | (F.substring(t, F.lit(2), F.length(t)) == F.substring(low, F.lit(2), F.length(t))))
        plain = F.when(low.isin(UNITS) & digit(before), 2).otherwise(0)
        # most words are in lower case: one comparison settles them
        return F.when((t >= "a") & (t == low), plain).when(t.isin(MARKS), -1).when(digit(t), 1).when(low.isin(UNITS) & digit(before), 2).when((i > 0) & name & ~before.isin(MARKS), 3).otherwise(0)

    kinds = F.transform("t_tok", lambda t, i: F.struct(F.get("t_low", i).alias("low"), slot(t, i).alias("slot")))
    df = df.withColumn(out, F.filter(kinds, lambda x: x["slot"] >= 0))
    names = F.array(*map(F.lit, SLOTS))
    hashed = F.transform(out, lambda x: F.when(x["slot"] == 0, F.xxhash64(x["low"]).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(F.get(names, x["slot"] - 1)).bitwiseAND(F.lit(-2))))
    return df.withColumn(f"{out}_h", hashed).drop("t_tok", "t_low")


def windows(tokens: str, sizes: list[int]) -> Column:
    """(pos, size, hash) of every window of the given sizes; the hash is of the template if that has LITERALS plain words, else of the values."""
    def each(n: int) -> Column:
        at = lambda i, k: F.get(f"{tokens}_h", i + k)
        plain = lambda i: sum((at(i, k).bitwiseAND(F.lit(1)) for k in range(1, n)), at(i, 0).bitwiseAND(F.lit(1)))
        template = lambda i: F.xxhash64(F.lit(n), *[at(i, k) for k in range(n)])
        values = lambda i: F.xxhash64(F.lit(-n), *[F.get(tokens, i + k)["low"] for k in range(n)])
        hashed = lambda i: F.when(plain(i) >= LITERALS, template(i)).otherwise(values(i))
        made = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("size"), hashed(i).alias("hash")))
        return F.when(F.size(tokens) >= n, made).otherwise(F.array().cast("array<struct<pos:int,size:int,hash:bigint>>"))

    return F.concat(*map(each, sizes))


def item_windows(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> tuple[DataFrame, list[int]]:
    """Windows of the benchmark and the sizes that occur (at most WINDOW of them)."""
    b = templates(benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("b_text")), "b_text", "b_tok")
    b = stored(b.select("item_id", "b_tok", "b_tok_h", F.size("b_tok").alias("item_tokens")).where(F.col("item_tokens") >= LITERALS), "leak-items")
    sizes = sorted({min(WINDOW, r[0]) for r in b.select(F.least("item_tokens", F.lit(WINDOW))).distinct().collect()})
    if not sizes:
        sizes = [WINDOW]
    w = b.select("item_id", "item_tokens", "b_tok", F.explode(windows("b_tok", sizes)).alias("w"))
    w = w.where(F.col("w.size") == F.least("item_tokens", F.lit(WINDOW)))
    w = w.select("item_id", "item_tokens", F.col("w.pos").alias("b_pos"), F.col("w.hash").alias("hash"), F.slice("b_tok", F.col("w.pos") + 1, F.col("w.size")).alias("b_part"))
    w = w.withColumn("exact", F.size(F.filter("b_part", lambda x: x["slot"] == 0)) < LITERALS)
    return stored(w, "leak-windows"), sizes


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """doc_id, text_hash, item_id, covered_tokens, item_tokens, n_slots, n_changed, kind for each leaked item of a document."""
    w, sizes = item_windows(benchmark)
    w = F.broadcast(w) if w.count() <= BROADCAST_WINDOWS else w
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash"), F.col(text).alias("d_text"))
    d = templates(d, "d_text", "d_tok").withColumn("d_win", windows("d_tok", sizes))
    # outer: an inner explode infers a filter that would compute the arrays once more, inside the lambdas
    hits = d.select("doc_id", "text_hash", "d_tok", F.explode_outer("d_win").alias("d_w")).withColumn("hash", F.col("d_w.hash")).join(w, "hash")
    pair = F.zip_with("b_part", F.slice("d_tok", F.col("d_w.pos") + 1, F.col("d_w.size")), lambda b, x: F.struct(b["low"].alias("b"), x["low"].alias("d"), b["slot"].alias("slot")))
    hits = hits.select("doc_id", "text_hash", "item_id", "item_tokens", "b_pos", "exact", F.col("d_w.size").alias("size"), (F.col("d_w.pos") - F.col("b_pos")).alias("shift"), F.transform(F.filter(pair, lambda x: x["slot"] > 0), lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d"))).alias("slots"))
    keys = ["doc_id", "text_hash", "item_id", "item_tokens", "size"]
    # Sets of one alignment are bounded by the item's length.
    of = lambda exact, c: F.collect_set(F.when(F.col("exact") == exact, F.col(c)))
    lines = hits.groupBy(*keys, "shift").agg(
        of(False, "b_pos").alias("at"), F.array_distinct(F.flatten(of(False, "slots"))).alias("slots"),
        of(True, "b_pos").alias("e_at"), F.array_distinct(F.flatten(of(True, "slots"))).alias("e_slots"),
    )
    # where the values of templates disagree, only the verbatim windows of the alignment stay
    agree = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["b"])))
    both = lambda c: F.when(agree, F.array_union(c, f"e_{c}")).otherwise(F.col(f"e_{c}")).alias(c)
    lines = lines.select(*keys, "shift", both("at"), both("slots")).where(F.size("at") > 0)
    items = lines.groupBy(*keys).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"),
        F.max(F.size(F.array_distinct(F.transform("slots", lambda x: x["b"])))).alias("n_slots"),
        F.min(F.size(F.filter("slots", lambda x: x["b"] != x["d"]))).alias("n_changed"),
    )
    new = F.transform("at", lambda p, k: F.least(F.col("size"), F.coalesce(F.get("at", k + 1) - p, F.col("size"))))
    items = items.withColumn("covered_tokens", F.aggregate(new, F.lit(0), lambda a, x: a + x))
    leaked = (F.col("covered_tokens") >= share * F.col("item_tokens")) | (F.col("covered_tokens") >= LONG)
    return items.where(leaked).select("doc_id", "text_hash", "item_id", "covered_tokens", "item_tokens", "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    docs, (text, key), back = neutral(docs, text, key)
    bad = stored(leaks(docs, benchmark, text, key).select(F.col("doc_id").alias("l_doc"), F.col("text_hash").alias("l_hash")).distinct(), "leaks")
    bad = small(bad, BROADCAST_IDS)
    same = docs[key].eqNullSafe(bad["l_doc"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == bad["l_hash"])
    return back(docs.join(bad, same, "left_anti"))
