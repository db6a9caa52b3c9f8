"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS cells.  Two
multinomials over the cells, one of the trusted documents and one of the whole
raw corpus, are smoothed by ALPHA; a document's score is the mean over its
n-grams, and SHRINK neutral ones, of log(p_trusted / p_raw).  Every document is
scored and meets one threshold, so equal texts get equal verdicts.  The
threshold is fitted on the labelled rows: the cut with the best balance of the
two classes' recalls (lost trusted rows weigh CARE times), and of equally good
cuts the lowest, so that doubtful documents stay.

Corpus counts cover all documents, the trusted counts and the threshold all
labels.  Labelled ids are broadcast up to ``broadcast_rows`` of them, else joined
by a shuffle, with the same counts.  No Python runs on executors.

Null and empty texts have no words, score 0 and fail the base rule.  A very long
text is one array of hashes.  Columns of any name pass through.  Repeated rows
are scored each.  Null ids are never trusted.  Without labels of both
kinds the threshold is minus infinity and only the base rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, neutral, small, stored, words

BUCKETS = 1 << 16
ALPHA = 1.0
#: n-grams of ratio 0 that are added to every text: few words decide little.
SHRINK = 32
#: Lost trusted rows count so many times as much as rejected rows that stay.
CARE = 4
#: Labelled ids and rejected ones are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of 64 bits of the table that keeps texts without a trusted id out of that shuffle.
BIT_ROWS = 1 << 20
#: Words of the window whose repeats are counted.
REPEAT = 5


def _repeat_positions(windows: str) -> Column:
    """Start positions of windows found twice or more, ascending: equal hashes are neighbours once sorted."""
    dup = F.transform("sorted", lambda e, k: F.when(((k > 0) & (F.get("sorted", k - 1)["x"] == e["x"])) | (F.get("sorted", k + 1)["x"] == e["x"]), e["i"]))
    return F.sort_array(F.array_compact(dup))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts and the word hashes of each text, as columns q_*."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("q_words", words(t)).withColumn("q_h", F.transform("q_words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("q_lines", lines).withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_win": F.when(F.size("q_h") >= REPEAT, F.transform(F.sequence(F.lit(0), F.size("q_h") - REPEAT), lambda i: F.xxhash64(*[F.get("q_h", i + k) for k in range(REPEAT)]))),
    }).drop("q_words", "q_lines")
    pairs = F.sort_array(F.transform("q_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("q_win")) < F.size("q_win"), pairs)).drop("q_win")
    out = out.withColumn("q_at", F.when(F.col("sorted").isNotNull(), _repeat_positions("sorted"))).drop("sorted")
    new = F.transform("q_at", lambda p, k: F.least(F.lit(REPEAT), F.coalesce(F.get("q_at", k + 1) - p, F.lit(REPEAT))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("q_at")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def grams(hashes: str) -> Column:
    """Cells of the words and of the pairs of neighbouring words."""
    pairs = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return F.concat(single, F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """All labelled ids with their quality, to be broadcast if they are at most so many."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return small(stored(ids, "quality-labels"), broadcast_rows)


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose q_id is in ids (trusted), and a few others; BIT_ROWS rows at most are broadcast. Ids of other types, or of unlike ones, are not told apart."""
    if (kind := docs.schema["q_id"].dataType.simpleString()) != ids.schema["trusted"].dataType.simpleString() or kind not in ("bigint", "int", "string"):
        return docs
    row = lambda c: F.pmod(F.xxhash64(c), F.lit(BIT_ROWS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({c}), 32), 64) as int))")
    bits = ids.select(row("trusted").alias("q_at"), bit("trusted").alias("q_bit")).groupBy("q_at").agg(F.bit_or("q_bit").alias("q_bits"))
    near = docs.withColumn("q_at", row("q_id")).join(F.broadcast(bits), "q_at")
    return near.where(F.col("q_bits").bitwiseAND(bit("q_id")) != 0).drop("q_at", "q_bits")


def ratios(docs: DataFrame, ids: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """(cell, ratio) for each cell of the raw corpus, BUCKETS rows at most."""
    good = ids.where("quality = 1").select(F.col("doc_id").alias("trusted"))
    d, same = docs.select(F.col(key).alias("q_id"), F.col(text).alias("q_text")), F.col("q_id") == F.col("trusted")
    if good.count() <= broadcast_rows:
        d = d.join(F.broadcast(good), same, "left").select("q_text", F.lit(1).alias("raw"), F.col("trusted").isNotNull().cast("int").alias("good"))
    else:  # only the trusted texts are shuffled
        d = d.select("q_text", F.lit(1).alias("raw"), F.lit(0).alias("good")).union(likely(d, good).join(good, same).select("q_text", F.lit(0), F.lit(1)))
    h = d.select("raw", "good", F.transform(words(F.col("q_text")), lambda w: F.xxhash64(w)).alias("q_h")).select("raw", "good", grams("q_h").alias("cells"))
    # An inner explode would infer a filter on the array, and its pushdown would inline q_h into the lambda: quadratic in a text's words.
    n = stored(h.select("raw", "good", F.explode_outer("cells").alias("cell")).groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("target")).where("cell is not null"), "quality-cells")
    raw, target = n.agg(F.sum("raw"), F.sum("target")).first()
    p = lambda c, total: (F.col(c) + ALPHA) / (float(total or 0) + ALPHA * BUCKETS)
    return n.select("cell", F.log(p("target", target) / p("raw", raw)).alias("ratio"))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_IDS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, float]:
    """Counts, score and labels of every row of docs (with the columns carry), and the threshold."""
    ids = trusted_ids(labels, broadcast_rows)
    model = F.broadcast(ratios(docs, ids, text, key, broadcast_rows))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = docs.select(F.col(key).alias("q_id"), F.col(text).alias("q_text"), *[F.col(c).alias(f"q_carry_{c}") for c in carry])
    d = counted(d, "q_text").withColumn("q_row", F.monotonically_increasing_id())
    held = ["q_id", *base, *[f"q_carry_{c}" for c in carry]]
    cells = d.select("q_row", *held, F.explode_outer(grams("q_h")).alias("cell"))
    # One row for each document leaves a task: the scan's own tasks sum up its n-grams.
    s = cells.join(model, "cell", "left").groupBy("q_row").agg(*[F.first(c).alias(c) for c in held], F.sum("ratio").alias("q_sum"), F.count("cell").alias("q_n"))
    s = stored(s.withColumn("score", F.coalesce("q_sum", F.lit(0.0)) / (F.col("q_n") + SHRINK)).drop("q_row", "q_sum", "q_n"), "quality-scores")
    seen = s.join(ids.withColumnRenamed("doc_id", "q_id"), "q_id")
    bins = seen.groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.sum(F.expr("cast(quality = 1 as int)")).alias("good"), F.sum(F.expr("cast(quality = 0 as int)")).alias("bad"))
    return s, threshold([(r.bin, r.good, r.bad) for r in bins.collect()])


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The best cut between bins of a thousandth: (bin, trusted rows, rejected rows)."""
    good, bad = sum(x[1] for x in bins), sum(x[2] for x in bins)
    best, cut, lost, out = 0.0, float("-inf"), 0, 0
    for b, g, r in sorted(bins) if good and bad else []:
        lost, out = lost + g, out + r
        if (gain := out / bad - CARE * lost / good) > best + 1e-12:
            best, cut = gain, (b + 1) / 1000
    return cut


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score for each row of docs."""
    s, cut = scored(docs, labels, text, key, broadcast_rows)
    kept = ~F.col("base_failed") & (F.col("score") >= cut)
    return s.select(F.col("q_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rejected rows. Rows of equal id and text share a verdict, which comes back by both."""
    docs, (text, key), back = neutral(docs, text, key)
    d = docs.withColumn("q_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    s, cut = scored(d, labels, text, key, broadcast_rows, carry=("q_hash",))
    bad = s.where(F.col("base_failed") | (F.col("score") < cut)).select(F.col("q_id").alias("b_id"), F.col("q_carry_q_hash").alias("b_hash")).distinct()
    bad = small(stored(bad, "quality-rejected"), BROADCAST_IDS)
    return back(d.join(bad, d[key].eqNullSafe(bad["b_id"]) & (d["q_hash"] == bad["b_hash"]), "left_anti"))
