"""The vocabulary filters and their chain.

A vocabulary has the columns term, n (occurrences) and is_person, and any more.
A filter takes and returns such a DataFrame; the chain runs the filters in the
order of their priorities.  Lists that filters need (known and common words,
ranks) come as DataFrames and are joined, so that they may be of any size; only
the 25 commonest names are a broadcast side, bounded by that number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from . import names as N
from . import terms as O

#: Words of the sections of a transcript.
SECTIONS = "direct cross redirect recross examination voir dire rebuttal continued resumed recalled".split()
CANONICAL = 25
EDITS = 2


@dataclass
class Filter:
    name: str
    priority: int
    apply: Callable[[DataFrame], DataFrame]
    enabled: bool = True


def chain(vocabulary: DataFrame, filters: list[Filter], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, dict[str, str]]:
    """The vocabulary after the enabled filters, by priority, and why filters were skipped: one whose plan is invalid leaves the vocabulary as it was.

    keep is applied to each result: tables.stored keeps plans short.
    """
    skipped = {}
    for f in sorted((f for f in filters if f.enabled), key=lambda f: f.priority):
        try:
            vocabulary = keep(f.apply(vocabulary))
        except (PySparkException, ValueError) as e:
            skipped[f.name] = str(e)[:300]
    return vocabulary, skipped


def excluded(vocabulary: DataFrame, patterns: list[str]) -> DataFrame:
    """Without terms in which one of the patterns is found; comments, blanks and invalid patterns say nothing."""
    good = [p for p in map(str.strip, patterns) if p and not p.startswith("#") and S.is_valid_pattern(p)]
    return vocabulary.where(~F.col("term").rlike("(?i)" + "|".join(f"(?:{p})" for p in good))) if good else vocabulary


def _dashless(term: Column) -> Column:
    return F.array_distinct(S.words(F.regexp_replace(term, "[-–—]+", " ")))


def without_header_terms(vocabulary: DataFrame) -> DataFrame:
    """Without terms of the sections of a transcript (unless a person's), full names with such a word, and two names in one."""
    section = F.array(*map(F.lit, SECTIONS))
    own = F.arrays_overlap(S.words(F.col("term")), section) & ~F.col("is_person")
    full = vocabulary.where("is_person").select(F.lower("term").alias("full")).distinct().withColumn("f", F.array_distinct(S.words(F.col("full"))))
    # A name lies in a term that has each of its words: counted over a join on the word.
    parts = full.where(F.size("f") >= 2).select("full", "f", F.explode("f").alias("w"))
    w = vocabulary.select("term").distinct().withColumn("t", _dashless(F.col("term"))).select("term", "t", F.explode("t").alias("w"))
    inside = w.join(parts, "w").groupBy("term", "t", "full", "f").agg(F.count("*").alias("k")).where(F.col("k") == F.size("f"))
    g = inside.groupBy("term").agg(F.first("t").alias("t"), F.collect_set("f").alias("fs"))
    two = F.exists("fs", lambda a: F.exists("fs", lambda b: ~F.arrays_overlap(a, b)))
    bad = g.where(F.arrays_overlap("t", section) | two).select("term")
    return vocabulary.where(~own).join(bad, "term", "left_anti")


def without_name_headers(vocabulary: DataFrame, common: DataFrame) -> DataFrame:
    """Without persons whose words, cut in two, are a part of a full name and common or section words; common: (term)."""
    named = vocabulary.where("is_person").select(S.words(F.col("term")).alias("w")).where(F.size("w") >= 2)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.size("w") - i + 1), lambda n: F.array_join(F.slice("w", i, n), " "))))
    parts = named.select(F.explode(runs).alias("part")).distinct()
    p = vocabulary.where("is_person").select("term").distinct().withColumn("t", S.words(F.replace(F.replace(F.col("term"), F.lit(" - "), F.lit(" ")), F.lit("-"), F.lit(" "))))
    p = p.where((F.size("t") >= 2) & (F.size(S.words(F.col("term"))) < 2))  # a term of several words is a full name itself
    cuts = p.select("term", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("k"))
    left, right = F.slice("t", F.lit(1), F.col("k")), F.slice("t", F.col("k") + 1, F.size("t") - F.col("k"))
    halves = cuts.select("term", F.monotonically_increasing_id().alias("id"), F.explode(F.array(F.struct(left.alias("name"), right.alias("rest")), F.struct(right.alias("name"), left.alias("rest")))).alias("h"))
    halves = halves.select("term", F.array_join("h.name", " ").alias("part"), F.col("h.rest").alias("rest")).join(parts, "part")
    known = common.select("term").union(common.sparkSession.createDataFrame([(s,) for s in SECTIONS], "term string")).distinct().select(F.col("term").alias("w"), F.lit(1).alias("k"))
    each = halves.select("term", "part", F.posexplode("rest").alias("pos", "w")).join(known, "w", "left").groupBy("term", "part").agg((F.count("k") == F.count("*")).alias("all"))
    return vocabulary.join(each.where("all").select("term").distinct(), "term", "left_anti")


def without_common_variants(vocabulary: DataFrame, common: DataFrame, top: int = CANONICAL) -> DataFrame:
    """Without longer terms that begin or end like one of the commonest full names, two edits off at most, all their other words common."""
    best = vocabulary.orderBy(F.desc("n"), "term").limit(top).where("is_person and instr(term, ' ') > 0")
    best = best.select(F.lower("term").alias("canonical"), F.size(S.words(F.col("term"))).alias("size"))
    t = vocabulary.select("term").distinct().withColumn("t", S.words(F.col("term")))
    j = t.join(F.broadcast(best), F.size("t") > F.col("size"))  # at most top rows on the right
    head, tail = F.slice("t", F.lit(1), F.col("size")), F.slice("t", F.size("t") - F.col("size") + 1, F.col("size"))
    rest = F.size("t") - F.col("size")
    side = F.array(F.struct(F.array_join(head, " ").alias("name"), F.slice("t", F.col("size") + 1, rest).alias("rest")), F.struct(F.array_join(tail, " ").alias("name"), F.slice("t", F.lit(1), rest).alias("rest")))
    h = j.select("term", "canonical", F.posexplode(side).alias("side", "h")).where(F.levenshtein("h.name", "canonical") <= EDITS)
    known = common.select(F.col("term").alias("w"), F.lit(1).alias("k")).distinct()
    each = h.select("term", "canonical", "side", F.posexplode("h.rest").alias("pos", "w")).join(known, "w", "left").groupBy("term", "canonical", "side").agg((F.count("k") == F.count("*")).alias("all"))
    return vocabulary.join(each.where("all").select("term").distinct(), "term", "left_anti")


def without_components(vocabulary: DataFrame) -> DataFrame:
    """Without single-word persons that are a word of a full name."""
    parts = vocabulary.where("is_person").select(S.words(F.col("term")).alias("w")).where(F.size("w") >= 2).select(F.explode("w").alias("part")).distinct()
    one = F.col("is_person") & ~F.contains(F.col("term"), F.lit(" "))
    return vocabulary.join(parts, one & (S.normal(F.col("term")) == F.col("part")), "left_anti")


def without_artifacts(vocabulary: DataFrame, common: DataFrame) -> DataFrame:
    """The artifact filter: terms around the commonest ones, common words at names, parts of names, headers."""
    v = N.substring_artifacts(vocabulary, CANONICAL)
    return without_name_headers(without_components(without_common_variants(v, common)), common)


def canonical_cut(n: Column, least: int = 10, fraction: float = 0.25) -> Column:
    """How many of n terms count as canonical: a quarter, ten at least, three quarters at most."""
    return F.least(F.greatest(F.lit(least), F.floor(n * fraction)), F.floor(n * 0.75))


def without_fragments(vocabulary: DataFrame, least: int = 10, fraction: float = 0.25) -> DataFrame:
    """Without rarer terms whose words are some of the words of a canonical term of several; terms of the top stay.

    Joined on the rarest word of the fragment, so that a word which many terms share pairs no more than its fragments.
    """
    counts = vocabulary.groupBy("term").agg(F.max("n").alias("n"))
    ranked = O.percentile_rank(counts).select("term", "rank")
    size = counts.agg(F.count("*").alias("size"))
    r = counts.join(ranked, "term").crossJoin(F.broadcast(size)).withColumn("top", F.col("rank") < canonical_cut(F.col("size"), least, fraction))
    r = r.withColumn("w", F.array_distinct(S.words(F.col("term"))))
    whole = r.where("top").where(F.size("w") > 1).select(F.col("w").alias("v"), F.explode("w").alias("word"))
    df = whole.groupBy("word").agg(F.count("*").alias("df"))
    low = r.where(~F.col("top")).select("term", "w", F.explode("w").alias("word")).join(df, "word", "left").groupBy("term", "w").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    bad = low.join(whole, "word").where((F.size("w") < F.size("v")) & (F.size(F.array_except("w", "v")) == 0)).select("term").distinct()
    return vocabulary.join(bad, "term", "left_anti")


def without_typos(vocabulary: DataFrame, known: DataFrame, shortest: int = 5, edits: int = 2) -> DataFrame:
    """One spelling of each group of long terms within two edits; a group is a term and the rarer ones that resemble it."""
    v = vocabulary.groupBy("term").agg(F.sum("n").alias("n"))
    t = v.where(F.length("term") >= shortest).select(F.lower("term").alias("low"), "term", "n")
    low = t.groupBy("low").agg(F.sum("n").alias("n")).select(F.col("low").alias("term"), "n")
    near = N._by_variants(low, edits).union(N._by_pieces(low, edits)).where("term <> other").where(F.levenshtein("term", "other") <= edits).select("term", "n", "other", "other_n").distinct()
    # A term that resembles a commoner one belongs to the commonest of these.
    lead = near.where("other_n > n or (other_n = n and other < term)").groupBy("term").agg(F.max_by("other", F.struct("other_n", "other")).alias("lead"))
    heads = low.select("term").join(lead.select("term"), "term", "left_anti").select(F.col("term").alias("lead"))
    groups = lead.join(heads, "lead").select(F.col("lead").alias("key"), F.col("term").alias("low")).union(lead.join(heads, "lead").select(F.col("lead").alias("key"), F.col("lead").alias("low")).distinct())
    variants = groups.join(t, "low").select("key", "term", "n", F.pow(F.lit(0.85) * F.col("n"), F.lit(1.1)).alias("weighted"))
    best = N.canonical(variants, known).select("key", F.col("term").alias("best"))
    bad = variants.join(best, "key").where(F.lower("term") != F.lower("best")).select("term").distinct()
    return vocabulary.join(bad, "term", "left_anti")


def regularised(vocabulary: DataFrame, known: DataFrame, passes: int = 1) -> DataFrame:
    """Fragments and typos go, in so many passes: what a pass removes lets other terms rise."""
    for _ in range(passes):
        vocabulary = without_typos(without_fragments(vocabulary), known)
    return vocabulary


def passes_through(single: float = 0.80, most: float = 0.85, mean: float = 0.65) -> Column:
    """Whether a phrase (with most, mean and n_words of phrase_rarity) is rare enough to skip the rarity filter."""
    return F.when(F.col("n_words") == 1, F.col("most") >= single).otherwise((F.col("most") >= most) & (F.col("mean") >= mean))


def without_common(vocabulary: DataFrame, ranks: DataFrame) -> DataFrame:
    """Without common phrases, persons' names aside; ranks: (term, percentile)."""
    r = O.phrase_rarity(vocabulary.select(F.col("term").alias("phrase")), ranks).where(O.is_common_phrase() & ~passes_through()).select(F.col("phrase").alias("common"))
    return vocabulary.join(r, ~F.col("is_person") & (F.col("term") == F.col("common")), "left_anti")


def is_common(ranks: DataFrame, top: int) -> DataFrame:
    """The words among the so many commonest; ranks: (term, rank)."""
    return ranks.where(F.col("rank") < top).select("term")


def gibberish(terms: DataFrame, known: DataFrame, surprise: DataFrame | None = None, limit: float = 5.5, edits: float = 0.35, like: float = 0.8) -> DataFrame:
    """(term) that hold a word of four letters or more that is not known, and that surprises or is near no known word.

    A word is near the closest known one within two edits if these are few for
    its length and the rest agrees; surprise: (term, surprise) of merge.gibberish.
    """
    letters = lambda x: F.regexp_replace(x, r"[^\p{L}]", "")
    w = terms.select("term").distinct().select("term", F.explode(F.filter(F.transform(S.words(F.col("term")), letters), lambda x: F.length(x) >= 4)).alias("w"))
    words = w.select(F.col("w").alias("term")).distinct().join(known.select("term").distinct(), "term", "left_anti")
    both = words.withColumn("n", F.lit(0)).union(known.select("term").distinct().withColumn("n", F.lit(1)))
    near = N._by_variants(both, EDITS).union(N._by_pieces(both, EDITS)).where("n = 0 and other_n = 1").select("term", "other").distinct().withColumn("d", F.levenshtein("term", "other")).where(F.col("d") <= EDITS)
    ratio = 1 - F.col("d") / (F.length("term") + F.length("other"))  # of letters that stay, when all edits replace
    ok = near.where((F.col("d") / F.length("term") <= edits) & (ratio >= like)).select("term").distinct()
    bad = words.join(ok, "term", "left_anti")
    if surprise is not None:
        bad = bad.union(words.join(surprise.where(F.col("surprise") > limit), "term", "left_semi")).distinct()
    return w.join(bad.select(F.col("term").alias("w")), "w", "left_semi").select("term").distinct()


def without_gibberish(vocabulary: DataFrame, known: DataFrame, surprise: DataFrame | None = None) -> DataFrame:
    bad = gibberish(vocabulary.where(~F.col("is_person")), known, surprise).select(F.col("term").alias("bad"))
    return vocabulary.join(bad, ~F.col("is_person") & (F.col("term") == F.col("bad")), "left_anti")


def without_unknown_people(vocabulary: DataFrame, known: DataFrame, least: int = 10) -> DataFrame:
    """Without longer persons' names of which no word is known."""
    bad = N.word_validity(vocabulary.where("is_person").where(F.length("term") >= least), known).where("validity = 0").select(F.col("term").alias("bad"))
    return vocabulary.join(bad, F.col("is_person") & (F.col("term") == F.col("bad")), "left_anti")


def per_term(vocabulary: DataFrame, known: DataFrame, ranks: DataFrame, surprise: DataFrame | None = None) -> DataFrame:
    """Rarity, gibberish and the validity of names, one after the other."""
    return without_unknown_people(without_gibberish(without_common(vocabulary, ranks), known, surprise), known)


def familiar(vocabulary: DataFrame, df: DataFrame, docs: int, least: int = 5, share: float = 0.64) -> DataFrame:
    """vocabulary with corpus_common: in at least so many documents and that share of all; df: (term, df)."""
    f = df.select(S.normal(F.col("term")).alias("low"), "df").groupBy("low").agg(F.max("df").alias("corpus_df"))
    common = (F.lit(docs) >= least) & (F.coalesce("corpus_df", F.lit(0)) >= least) & (F.coalesce("corpus_df", F.lit(0)) >= share * docs)
    return vocabulary.join(f, S.normal(F.col("term")) == F.col("low"), "left").withColumn("corpus_common", common).drop("low", "corpus_df")


def default_filters(known: DataFrame, ranks: DataFrame, common: DataFrame, patterns: list[str] | None = None) -> list[Filter]:
    """Names, exclusions, artifacts, headers, spellings, and the fused filter of single terms."""
    return [
        Filter("regex exclusion", 15, lambda v: excluded(v, patterns or [])),
        Filter("artifacts", 20, lambda v: without_artifacts(v, common)),
        Filter("transcript headers", 25, without_header_terms),
        Filter("spellings", 30, lambda v: regularised(v, known)),
        Filter("single terms", 40, lambda v: per_term(v, known, ranks)),
    ]


def partial_filters(known: DataFrame, ranks: DataFrame, common: DataFrame, patterns: list[str] | None = None) -> list[Filter]:
    """What runs on results that are not yet whole."""
    return [f for f in default_filters(known, ranks, common, patterns) if f.priority in (15, 20, 40)]


def counts(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count("*").alias("n_terms"), F.count_if("is_person").alias("n_people"))


def duplicates_together(vocabulary: DataFrame, matches: DataFrame) -> DataFrame:
    """vocabulary with place: by falling count, a term that matches another right after it; matches: (term, other)."""
    at = O.percentile_rank(vocabulary.select("term", "n").distinct()).select("term", "rank")
    m = matches.join(at.select(F.col("term").alias("other"), F.col("rank").alias("other_rank")), "other").groupBy("term").agg(F.min("other_rank").alias("to"))
    v = vocabulary.join(at, "term").join(m, "term", "left")
    return v.withColumn("place", F.struct(F.coalesce("to", "rank").alias("at"), F.col("to").isNotNull().alias("moved"), "rank")).drop("rank", "to")


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, and its place among all rows is kept."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")
