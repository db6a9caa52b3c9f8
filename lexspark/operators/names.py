"""Name and phrase matching: the joins that clean a vocabulary.

Set comparisons of words go through a join on a word (or on a length and a
first-letter block) before they are confirmed, so no step compares all terms
with all terms.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S


def with_words(terms: DataFrame, term: str = "term") -> DataFrame:
    return terms.withColumn("words", F.array_sort(F.array_distinct(F.split(F.lower(F.btrim(term)), r"\s+"))))


def reversed_names(terms: DataFrame) -> DataFrame:
    """(name_key, term, n_forms, total): spellings that hold the same words in any order; terms: (term, n)."""
    g = with_words(terms).withColumn("name_key", F.array_join("words", " "))
    return g.groupBy("name_key").agg(F.max_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("n_forms"), F.sum("n").alias("total"))


def fragments(terms: DataFrame) -> DataFrame:
    """Terms whose words are a proper part of another term's; terms: (term)."""
    t = with_words(terms.select("term").distinct()).withColumn("size", F.size("words"))
    w = t.select("term", "words", "size", F.explode("words").alias("w"))
    other = w.select(F.col("term").alias("whole"), F.col("size").alias("whole_size"), "w")
    # A fragment shares each of its words with the whole: counted over a join on the word.
    m = w.join(other, "w").where("term <> whole and size < whole_size").groupBy("term", "whole", "size").agg(F.count("*").alias("met"))
    return m.where("met = size").groupBy("term").agg(F.min("whole").alias("whole"))


def absorbed(terms: DataFrame) -> DataFrame:
    """Single words that occur in one longer name only: (term, full_name, n, total); terms: (term, n)."""
    t = with_words(terms).withColumn("size", F.size("words"))
    full = t.where("size > 1").select(F.col("term").alias("full_name"), F.col("n").alias("full_n"), F.explode("words").alias("w"))
    one = full.groupBy("w").agg(F.count("*").alias("k"), F.min("full_name").alias("full_name"), F.min("full_n").alias("full_n")).where("k = 1")
    s = t.where("size = 1").withColumn("w", F.col("words")[0])
    return s.join(one, "w").select("term", "full_name", "n", (F.col("n") + F.col("full_n")).alias("total"))


def shared_last_names(terms: DataFrame, least: int = 2) -> DataFrame:
    p = F.split(F.lower(F.btrim("term")), r"\s+")
    t = terms.withColumn("p", p).where(F.size("p") >= 2)
    return t.groupBy(F.element_at("p", -1).alias("last_name")).agg(F.countDistinct(F.element_at("p", 1)).alias("n_first")).where(F.col("n_first") >= least)


def component_names(terms: DataFrame) -> DataFrame:
    """terms without the single words that are parts of longer ones."""
    t = with_words(terms).withColumn("size", F.size("words"))
    parts = t.where("size > 1").select(F.explode("words").alias("w")).distinct()
    return t.join(parts, (F.col("size") == 1) & (F.col("words")[0] == F.col("w")), "left_anti").drop("words", "size")


#: Words up to this length meet by their deletion variants, longer ones by pieces.
VARIANTS_UP_TO = 24


def _variants(term: str, distance: int):
    """The word without any of its letters, up to ``distance`` times: words within that distance share one."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    level = F.array(F.col(term))
    every = level
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, without)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def _by_variants(t: DataFrame, distance: int) -> DataFrame:
    v = t.where(F.length("term") <= VARIANTS_UP_TO).select("term", "n", F.explode(_variants("term", distance)).alias("v"))
    other = v.select(F.col("term").alias("other"), F.col("n").alias("other_n"), "v")
    return v.join(other, "v").select("term", "n", "other", "other_n")


def _by_pieces(t: DataFrame, distance: int) -> DataFrame:
    """The word cut into distance + 1 pieces: one stands unchanged in the other word, moved by at most ``distance``."""
    k = distance + 1
    t = t.where(F.length("term") > VARIANTS_UP_TO - distance).withColumn("len", F.length("term"))
    edge = lambda i: F.floor(F.col("len") * i / k).cast("int")
    piece = F.array(*[F.struct(F.lit(i).alias("i"), edge(i).alias("from"), (edge(i + 1) - edge(i)).alias("size")) for i in range(k)])
    left = t.select("term", "n", "len", F.explode(piece).alias("p")).select("term", "n", "len", F.col("p.i").alias("i"), F.substring("term", F.col("p.from") + 1, F.col("p.size")).alias("bit"))
    both = t.select(F.col("term").alias("other"), F.col("n").alias("other_n"), F.explode(F.sequence(F.col("len") - distance, F.col("len") + distance)).alias("len"))
    both = both.select("other", "other_n", "len", F.explode(piece).alias("p"))
    both = both.select("other", "other_n", "len", "p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p.from") - distance), F.col("p.from") + distance)).alias("at"))
    right = both.select("other", "other_n", "len", F.col("p.i").alias("i"), F.substring("other", F.col("at") + 1, F.col("p.size")).alias("bit")).distinct()
    return left.join(right, ["len", "i", "bit"]).select("term", "n", "other", "other_n")


def typo_pairs(terms: DataFrame, shortest: int = 5, distance: int = 2, ratio: int = 10) -> DataFrame:
    """(term, canonical, canonical_n, distance): rare words within an edit distance of words ``ratio`` times as frequent; terms: (term, n).

    Exact without an all-pairs join: candidates meet in an equi-join, and the
    edit distance confirms them.
    """
    t = terms.where(F.length("term") >= shortest).select("term", "n")
    met = _by_variants(t, distance).union(_by_pieces(t, distance)).where(F.col("n") * ratio <= F.col("other_n"))
    pairs = met.select("term", F.col("other").alias("canonical"), F.col("other_n").alias("canonical_n")).distinct()
    return pairs.withColumn("distance", F.levenshtein("term", "canonical")).where(F.col("distance") <= distance)


#: Likeness of names, and of the words in which names differ that share one; shortest names that two edits may part.
LIKE, LIKE_WORD, LONG_NAME = 0.85, 0.75, 8


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def are_alike(a: str, b: str, threshold: float = LIKE) -> bool:
    """Lower-case names of a high ratio; or that share a word and differ in as many words, each alike."""
    if _ratio(a, b) >= threshold:
        return True
    x, y = set(a.split()), set(b.split())
    if len(a.split()) < 2 or len(b.split()) < 2 or not x & y or len(x - y) != len(y - x) or not x - y:
        return False
    return all(_ratio(u, v) >= LIKE_WORD for u, v in zip(sorted(x - y), sorted(y - x)))


def similar_pairs(terms: DataFrame, threshold: float = LIKE) -> DataFrame:
    """(a, b) of names with the same first letter that are alike, or within two edits and long; a before b in code order; terms: (term).

    Candidates meet in equi-joins, no block is compared with itself: names of a
    ratio r share all but 2 (1 - r) of their pairs of letters, so the rarest of
    these suffice as keys; names that share a word meet on it; and names within
    two edits meet by what typo_pairs uses.  The ratio then confirms.
    """
    t = terms.select("term").distinct().withColumn("low", F.lower("term")).withColumn("first", F.substring("low", 1, 1)).withColumn("n", F.length("low"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: F.substring("low", i, F.lit(2))))
    g = t.where("n > 0").select("term", "low", "first", "n", F.explode(pairs).alias("bit"))
    rare = g.groupBy("bit").agg(F.count("*").alias("df"))
    ranked = g.join(rare, "bit").groupBy("term", "low", "first", "n").agg(F.array_sort(F.collect_list(F.struct("df", "bit"))).alias("bits"))
    # At most this many of a name's different pairs are missing in a name that is alike.
    lost = F.least(F.size("bits") - 1, F.floor(4 * (1 - threshold) / (2 * threshold) * F.col("n")).cast("int") + 1)
    keys = ranked.select("term", "low", "first", "n", F.explode(F.slice("bits", F.lit(1), lost + 1)).alias("k")).select("term", "low", "first", "n", F.col("k.bit").alias("key"))
    by_word = t.select("term", "low", "first", "n", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("key")).where(F.instr("low", " ") > 0)
    met = None
    for k in (keys, by_word):
        other = k.select(F.col("term").alias("b"), F.col("low").alias("b_low"), "first", F.col("n").alias("b_n"), "key")
        one = k.join(other, ["first", "key"]).where("low < b_low or (low = b_low and term < b)").select(F.col("term").alias("a"), F.col("low").alias("a_low"), "b", "b_low")
        met = one if met is None else met.union(one)
    close = t.withColumn("term", F.col("low")).select("term", F.lit(1).alias("n")).distinct()
    near = _by_variants(close, 2).union(_by_pieces(close, 2)).where("term < other").where((F.length("term") >= LONG_NAME) & (F.length("other") >= LONG_NAME)).where(F.substring("term", 1, 1) == F.substring("other", 1, 1))
    near = near.where(F.levenshtein("term", "other") <= 2).select(F.col("term").alias("a_low"), F.col("other").alias("b_low")).distinct()

    def confirm(parts):
        for part in parts:
            yield part[[are_alike(x, y, threshold) for x, y in zip(part["a_low"], part["b_low"])]][["a", "b"]]

    alike = met.distinct().mapInPandas(confirm, "a string, b string")
    spelt = t.select("term", "low")
    edits = near.join(spelt.select(F.col("term").alias("a"), F.col("low").alias("a_low")), "a_low").join(spelt.select(F.col("term").alias("b"), F.col("low").alias("b_low")), "b_low").select("a", "b")
    return alike.union(edits).distinct()


def similar_names(terms: DataFrame, threshold: float = LIKE) -> DataFrame:
    """(term, seed): by falling count, a name joins the first seed that it resembles, or becomes one; terms: (term, n).

    The order matters, so the pairs of a first letter are walked by one task,
    which is linear in them; names without a like one never get there.
    """

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        like: dict[str, set[str]] = {}
        for a, b in zip(block["a"], block["b"]):
            like.setdefault(a, set()).add(b)
            like.setdefault(b, set()).add(a)
        n = dict(zip(block["a"], block["a_n"])) | dict(zip(block["b"], block["b_n"]))
        seeds: dict[str, int] = {}
        group = {}
        for term in sorted(like, key=lambda x: (-n[x], x)):
            mine = [x for x in like[term] if x in seeds]
            group[term] = min(mine, key=seeds.__getitem__) if mine else term
            if not mine:
                seeds[term] = len(seeds)
        return pd.DataFrame(list(group.items()), columns=["term", "seed"])

    t = terms.groupBy("term").agg(F.sum("n").alias("n"))
    p = similar_pairs(t, threshold).join(t.select(F.col("term").alias("a"), F.col("n").alias("a_n")), "a").join(t.select(F.col("term").alias("b"), F.col("n").alias("b_n")), "b")
    seeds = p.groupBy(F.substring(F.lower("a"), 1, 1)).applyInPandas(walk, "term string, seed string")
    return t.select("term").join(seeds, "term", "left").select("term", F.coalesce("seed", "term").alias("seed"))


def with_form(people: DataFrame) -> DataFrame:
    """people with form, the normal form of the term without what transcripts leave at names."""
    return people.withColumn("form", S.name_form(S.without_artifacts(F.col("term"))))


def canonical(variants: DataFrame, known: DataFrame) -> DataFrame:
    """(key, term, branch, total) of each group of spellings; variants: (key, term, n, weighted), known: (term) in lower case.

    The only spelling whose words are all known wins; else the highest score
    does, among the known ones if there are several: the weighted count, lower
    for misread characters and capitals, higher for title case.
    """
    w = variants.select("key", "term", F.explode(F.transform(S.words(F.col("term")), lambda x: F.btrim(x, F.lit(".,;:'\"()-")))).alias("w"))
    k = w.join(known.select(F.col("term").alias("w"), F.lit(1).alias("k")).distinct(), "w", "left")
    k = k.groupBy("key", "term").agg((F.count("k") == F.count("*")).alias("known"))
    word = F.filter(F.split(S.bare(F.col("term")), r"\s+"), lambda x: F.length(x) > 1)
    title = (F.size(word) > 0) & F.forall(word, lambda x: x.rlike(r"^\p{Lu}[^\p{Lu}]*$") & x.rlike(r"^.[^\p{Lu}]*\p{Ll}"))
    caps = (F.col("term") == F.upper("term")) & (F.length("term") > 1)
    score = F.col("weighted") * F.when(S.has_ocr_signs(F.col("term")), 0.9).otherwise(1.0) * F.when(title, 1.3).when(caps, 0.8).otherwise(1.0)
    v = variants.join(k, ["key", "term"], "left").withColumns({"known": F.coalesce("known", F.lit(False)), "score": score})
    best = F.max_by("term", F.struct("score", "term"))
    g = v.groupBy("key").agg(F.count_if("known").alias("k"), F.max_by("term", F.struct("known", "score", "term")).alias("best_known"), best.alias("best"), F.sum("n").alias("total"), F.count("*").alias("size"))
    branch = F.when(F.col("size") == 1, "single").when(F.col("k") == 1, "single_known").when(F.col("k") == 0, "none_known").otherwise("multiple_known")
    return g.select("key", F.when(F.col("k") == 0, F.col("best")).otherwise(F.col("best_known")).alias("term"), branch.alias("branch"), "total")


def titled(people: DataFrame) -> DataFrame:
    """people with name, title, last and firsts: the title before a name, its last word, and the words before that."""
    p = people.withColumn("s", S.title_split(F.col("term")))
    w = F.split(F.col("s.name"), r"\s+")
    return p.select(*people.columns, F.col("s.name").alias("name"), F.col("s.title").alias("title"), F.lower(F.element_at(w, -1)).alias("last"), F.lower(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ")).alias("firsts"))


def titles_resolved(people: DataFrame) -> DataFrame:
    """(term, title, target): each titled name, and the full name that it stands for, null if it stands for itself; people: (term, n).

    One full name of that last word takes it, unless the last word is shared by
    several people and the title says nothing; of several, the one with the same
    first names; else, if neither title nor last name tells them apart, the
    commonest.
    """
    t = titled(people)
    full = t.where("title = '' and firsts <> ''")
    shared = t.where("firsts <> ''").groupBy("last").agg((F.countDistinct("firsts") >= 2).alias("shared"))
    index = full.groupBy("last").agg(F.countDistinct("firsts").alias("k"), F.max_by("term", F.struct("n", "term")).alias("best"))
    same = full.groupBy("last", "firsts").agg(F.max_by("term", F.struct("n", "term")).alias("same"))
    x = t.where("title <> ''").join(index, "last", "left").join(shared, "last", "left").join(same, ["last", "firsts"], "left")
    vague = ~S.is_role_title(F.col("title")) & (F.col("firsts") == "")
    common = F.coalesce("shared", F.lit(False))
    target = F.when(F.col("k") == 1, F.when(~(common & vague), F.col("best"))).when(F.col("same").isNotNull(), F.col("same")).when(~S.is_role_title(F.col("title")) & ~common, F.col("best"))
    return x.select("term", "title", F.when(F.col("k").isNotNull(), target).alias("target"), "n")


def with_titles(people: DataFrame) -> DataFrame:
    """(term, n): full names with the counts of the titled ones that stand for them, and the first role title in brackets."""
    r = titles_resolved(people)
    role = F.when(S.is_role_title(F.col("title")), S.title_case(F.rtrim(F.col("title"), F.lit("."))))
    more = r.where("target is not null").groupBy(F.col("target").alias("term")).agg(F.sum("n").alias("more"), F.min(role).alias("role"))
    left = people.join(r.where("target is not null").select("term"), "term", "left_anti")
    out = left.join(more, "term", "left")
    return out.select(F.when(F.col("role").isNotNull(), F.concat("term", F.lit(" ("), "role", F.lit(".)"))).otherwise(F.col("term")).alias("term"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def likely_duplicates(people: DataFrame) -> DataFrame:
    """(shorter, longer): names with the same first and last word, all words of one in the other."""
    w = people.select("term").distinct().withColumn("w", S.words(F.col("term"))).where(F.size("w") >= 2)
    w = w.select("term", F.array_distinct("w").alias("w"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))
    other = w.select(F.col("term").alias("longer"), F.col("w").alias("v"), "first", "last")
    return w.join(other, ["first", "last"]).where((F.size("w") < F.size("v")) & (F.size(F.array_except("w", "v")) == 0)).select(F.col("term").alias("shorter"), "longer")


def word_validity(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(term, validity): the share of a term's words that are known."""
    w = terms.select("term").distinct().select("term", F.posexplode(S.words(F.col("term"))).alias("pos", "w"))
    k = w.join(known.select(F.col("term").alias("w"), F.lit(1).alias("k")).distinct(), "w", "left")
    return k.groupBy("term").agg(F.round(F.count("k") / F.count("*"), 6).alias("validity"))


def substring_artifacts(terms: DataFrame, top: int = 25) -> DataFrame:
    """terms without those that contain one of the ``top`` commonest multi-word terms; terms: (term, n)."""
    best = terms.where(F.instr("term", " ") > 0).orderBy(F.desc("n"), "term").limit(top).select(F.lower("term").alias("canonical"))
    low = F.lower("term")
    return terms.join(F.broadcast(best), (F.instr(low, F.col("canonical")) > 0) & (low != F.col("canonical")), "left_anti")


#: Roles of people and places, by the first pattern that names them.
ROLES = [
    (r"(?i)plaintiff['s]?\s+(?:attorney|counsel|lawyer)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Plaintiff attorney"),
    (r"(?i)defendant['s]?\s+(?:attorney|counsel|lawyer)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Defendant attorney"),
    (r"(?i)plaintiff\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Plaintiff"),
    (r"(?i)defendant\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Defendant"),
    (r"(?i)treating\s+(?:physician|doctor)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Treating physician"),
    (r"(?i)(?:Dr\.|Doctor)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Medical professional"),
    (r"(?i)([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*),?\s+(?:a|an)\s+(?:nurse|physician|surgeon|doctor|therapist)", "Medical professional"),
    (r"(?i)witness\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)", "Witness"),
    (r"(?i)([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+testified", "Witness"),
    (r"(?i)([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+(?:was called as a|called to testify)", "Witness"),
]
PLACES = [
    (r"(?i)accident\s+(?:at|on|near)\s+([A-Z][a-zA-Z\s]+)", "Accident location"),
    (r"(?i)incident\s+(?:occurred|happened)\s+(?:at|on|near)\s+([A-Z][a-zA-Z\s]+)", "Incident location"),
    (r"(?i)collision\s+(?:at|on|near)\s+([A-Z][a-zA-Z\s]+)", "Collision location"),
    (r"(?i)(?:at|to|from|near)\s+([A-Z][a-zA-Z\s]+(?:Hospital|Medical Center|Clinic))", "Medical facility"),
    (r"(?i)([A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+)\s+(?:Hospital|Medical Center|Clinic)", "Medical facility"),
    (r"(?i)surgery\s+(?:at|performed at)\s+([A-Z][a-zA-Z\s]+)", "Surgery location"),
    (r"(?i)treatment\s+(?:at|received at)\s+([A-Z][a-zA-Z\s]+)", "Treatment location"),
    (r"(?i)([A-Z][a-zA-Z]+(?:\s+[&,]\s+[A-Z][a-zA-Z]+)+)\s+(?:LAW FIRM|LLP|PC|PLLC)", "Law firm"),
    (r"(?i)([A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+)\s+&\s+([A-Z][a-zA-Z]+)", "Law firm"),
    (r"(?i)THE\s+([A-Z][a-zA-Z\s]+)\s+LAW FIRM", "Law firm"),
    (r"(?i)employed\s+(?:at|by)\s+([A-Z][a-zA-Z\s]+)", "Workplace"),
    (r"(?i)works\s+(?:at|for)\s+([A-Z][a-zA-Z\s]+)", "Workplace"),
]
NO_ROLE, NO_PLACE = "Person in case", "Location mentioned in case"


def _mentions(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(hit, k, role, w): what each pattern captured, in lower case, by its words."""
    def hits(pattern: str, k: int):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda h: F.struct(F.lower(h).alias("hit"), F.lit(k).alias("k")))

    each = F.array(*[hits(p, k) for k, (p, _) in enumerate(patterns)])
    found = texts.select(F.explode(F.flatten(each)).alias("m")).select("m.hit", "m.k").distinct()
    names = F.array(*[F.lit(r) for _, r in patterns])
    return found.select("hit", "k", F.get(names, F.col("k")).alias("role"), F.explode(S.words(F.col("hit"))).alias("w"))


def roles(people: DataFrame, texts: DataFrame) -> DataFrame:
    """(person, role): by the first pattern, in order, that captured the name or a part of it; doctors by their title, others have no role."""
    low = F.btrim(F.replace(F.replace(F.lower("person"), F.lit("dr."), F.lit("")), F.lit("doctor"), F.lit("")))
    p = people.select("person").distinct().withColumn("low", low)
    m = p.withColumn("w", F.explode(F.split("low", r"\s+"))).join(_mentions(texts, ROLES), "w").where((F.instr("hit", F.col("low")) > 0) | (F.instr(F.col("low"), F.col("hit")) > 0))
    best = m.groupBy("person").agg(F.min_by("role", "k").alias("role"))
    default = F.when(F.col("person").rlike("^(Dr\\.|Doctor)"), "Medical professional").otherwise(NO_ROLE)
    return p.select("person").join(best, "person", "left").select("person", F.coalesce("role", default).alias("role"))


def places(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(place, role): by the first pattern that captured a place of which half of the fewer words agree; found: (place)."""
    p = found.select("place").distinct().withColumn("words", F.array_distinct(S.words(F.col("place"))))
    hits = _mentions(texts, PLACES)
    size = hits.groupBy("hit", "k", "role").agg(F.countDistinct("w").alias("n"))
    met = p.select("place", F.size("words").alias("m"), F.explode("words").alias("w")).join(hits.distinct(), "w").groupBy("place", "m", "hit", "k", "role").agg(F.count("*").alias("both"))
    ok = met.join(size, ["hit", "k", "role"]).where("2 * both >= least(m, n)")
    best = ok.groupBy("place").agg(F.min_by("role", "k").alias("role"))
    return p.select("place").join(best, "place", "left").select("place", F.coalesce("role", F.lit(NO_PLACE)).alias("role"))
