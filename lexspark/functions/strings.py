"""Forms of names and terms: normal forms, titles, patterns, cuts and labels, as Column expressions.

Nothing here runs Python on executors.  Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda computes what it captures anew for each element, but not its own variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bare(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normal(term: Column) -> Column:
    return F.lower(bare(term))


def words(term: Column) -> Column:
    """Lower-case words; the empty term has none."""
    return F.filter(F.split(normal(term), r"\s+"), lambda x: x != "")


def title_case(x: Column) -> Column:
    """The first letter of each run of letters large, the others small."""
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


#: What transcripts leave at names, in order of removal.
NAME_ARTIFACTS = [
    r"(?i)\s+\d+\s*[QA](?:\s+|$)",
    r"(?i):\s*\w+.*$",
    r"(?i)\s+\d+$",
    r"(?i)^\d+\s+(?:MR|MS|MRS|DR)?\s*",
    r"(?i)\s+\d+\s*(?:MR|MS|MRS|DR)$",
    r"(?i)\s+\d*\s*of$",
    r"(?i)\s+(?:Okay|Yes|No|Right)$",
    r"(?i)\s+(?:MR|MS|MRS|DR)$",
]
#: Titles before a name; the first say nothing of a role.
GENERIC_TITLES = ["mr.", "ms.", "mrs."]
ROLE_TITLES = ["dr.", "hon.", "judge", "justice", "senator", "nurse", "officer", "trooper", "investigator", "referee"]


def without_artifacts(name: Column) -> Column:
    """A name without what a transcript left at it; as it was, if nothing would stay."""
    x = bare(name)
    for pattern in NAME_ARTIFACTS:
        x = bare(F.regexp_replace(x, pattern, ""))
    return F.when(x == "", bare(name)).otherwise(x)


def name_form(name: Column) -> Column:
    """The form under which spellings of a name agree: no punctuation but hyphens and apostrophes, no possessive, in title case."""
    x = bare(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}_\s\-']", ""), r"\s+", " "))
    own = lambda w: F.when(F.lower(w).endswith("'s"), F.substring(w, F.lit(1), F.length(w) - 2)).when(F.lower(w).endswith("s'") & (F.length(w) > 2), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return title_case(F.array_join(F.transform(F.split(x, " "), own), " "))


def title_split(name: Column) -> Column:
    """(name, title): the title before a name, with its dot, in lower case; empty if there is none."""
    titles = GENERIC_TITLES + ROLE_TITLES
    one = "|".join(re.escape(t[:-1]) + r"\.?" if t.endswith(".") else re.escape(t) for t in titles)

    def parted(x: Column) -> Column:
        rest = bare(F.regexp_extract(x, rf"(?is)^(?:{one}) (.+)$", 1))
        title = _mapped(F.rtrim(F.lower(F.regexp_extract(x, rf"(?is)^({one}) .+$", 1)), F.lit(".")), {t.rstrip("."): t for t in titles})
        return F.when(rest != "", F.struct(rest.alias("name"), title.alias("title"))).otherwise(F.struct(x.alias("name"), F.lit("").alias("title")))

    return let(bare(name), parted)


def is_role_title(title: Column) -> Column:
    return F.rtrim(F.lower(title), F.lit(".")).isin([t.rstrip(".") for t in ROLE_TITLES])


def lookup_form(word: Column, original: Column | None = None) -> Column:
    """Without apostrophes, if the word was in small letters: names keep them."""
    source = word if original is None else original
    return F.when(source == F.lower(source), F.replace(word, F.lit("'"), F.lit(""))).otherwise(word)


def truncated(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(x)


def sentences_with_ends(text: Column) -> Column:
    """(start, end) of the sentences of a text, white space between them left out."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    gaps = F.transform(F.regexp_extract_all(text, F.lit(r"(?<=[.!?])\s+"), F.lit(0)), lambda g: F.length(g))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        end = a["at"] + x["n"]
        one = F.array(F.struct(a["at"].alias("start"), end.alias("end")))
        return F.struct((end + x["gap"]).alias("at"), F.when(x["n"] > 0, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    each = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), F.coalesce(F.get(gaps, i), F.lit(0)).alias("gap")))
    return F.aggregate(each, begin, add, lambda a: a["out"])


def cut_at_sentence(text: Column, most: int) -> Column:
    """Whole sentences up to so many characters, if they fill half; else cut at a word, if that fills half; else hard; with dots."""
    within = lambda spans: F.filter(spans, lambda s: s["end"] <= most)
    end = F.coalesce(F.array_max(F.transform(within(sentences_with_ends(text)), lambda s: s["end"])), F.lit(0))
    head = F.substring(text, F.lit(1), F.lit(most))
    space = most - F.locate(" ", F.reverse(head))  # characters before the last space
    by_word = F.when(F.contains(head, F.lit(" ")) & (space > most // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    cut = let(end, lambda e: F.when(e > most // 2, F.concat(bare(F.substring(text, F.lit(1), e)), F.lit("..."))).otherwise(F.concat(bare(by_word), F.lit("..."))))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def word_edge(text: Column, pos: Column, most: int, left: bool) -> Column:
    """A place at most so far left or right of pos that cuts no word, or else that far."""
    if left:
        far = F.greatest(F.lit(0), pos - most)
        step = F.locate(" ", F.substring(text, far + 1, pos - far))
        return F.when(far == 0, 0).when(step > 0, far + step - 1).otherwise(pos)
    far = F.least(F.length(text), pos + most)
    back = F.locate(" ", F.reverse(F.substring(text, pos + 1, far - pos)))
    return F.when((far == F.length(text)) | (back == 0), far).otherwise(far - back + 1)


def file_name(x: Column) -> Column:
    return F.regexp_replace(x, r'[<>:"/\\|?*]', "_")


#: The categories, and other words for them.
CATEGORIES = ["Person", "Place", "Medical", "Technical", "Unknown"]
CATEGORY_WORDS = {
    "name": "Person", "names": "Person", "people": "Person", "individual": "Person",
    "org": "Place", "organization": "Place", "location": "Place",
    "med": "Medical", "health": "Medical", "healthcare": "Medical",
    "tech": "Technical", "legal": "Technical",
    "other": "Unknown",
}
ENTITY_CATEGORIES = {"PERSON": "Person", "ORG": "Place", "GPE": "Place", "LOC": "Place"}


def _mapped(x: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[x]


def category(x: Column) -> Column:
    """A category from its name or another word for it; Unknown for all else, null too."""
    return F.coalesce(_mapped(F.lower(x), {c.lower(): c for c in CATEGORIES} | CATEGORY_WORDS), F.lit("Unknown"))


def entity_category(label: Column) -> Column:
    return F.coalesce(_mapped(label, ENTITY_CATEGORIES), F.lit("Unknown"))


def any_literal(texts: list[str]) -> str:
    """One pattern for any of the texts, as a user sees it; blanks are left out."""
    return "|".join(re.escape(t.strip()) for t in texts if t.strip())


def is_valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def indicator(term: Column, texts: list[str], override: str | None = None) -> Column:
    """Whether a term holds one of the texts, or fits the pattern that takes their place if it is valid."""
    pattern = override if override and is_valid_pattern(override) else any_literal(texts)
    return term.rlike(f"(?i){pattern}") if pattern else F.lit(False)


#: Signs of misread characters.
OCR_PAIRS = ["rn", "vv", "iii", "lll"]
OCR_DIGITS = "0158"
OCR_PATTERNS = [
    r"[A-Za-z][0-9][A-Za-z]",
    r"[A-Z][a-z][A-Z].*[A-Z]",
    r"[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{5,}",
]


def has_doubtful_digit(term: Column) -> Column:
    """A digit that looks like a letter, next to one."""
    return term.rlike(rf"\p{{L}}[{OCR_DIGITS}]|[{OCR_DIGITS}]\p{{L}}")


def has_ocr_signs(term: Column) -> Column:
    return (F.length(term) >= 3) & (F.lower(term).rlike("|".join(OCR_PAIRS)) | has_doubtful_digit(term) | term.rlike("|".join(f"(?:{p})" for p in OCR_PATTERNS)))


#: Patterns of texts that are no terms.
VARIATIONS = [
    r"^[a-z]+\(s\)$",
    r"^[a-z]+s\(s\)$",
    r"^[a-z]+\([a-z]+\)$",
    r"^[a-z]+'s$",
    r"^[a-z]+-[a-z]+$",
]
OCR_ERRORS = [
    r"^[A-Za-z]+-[A-Z][a-z]",
    r".*[0-9][A-Za-z]{2,}[0-9]",
    r"[A-Za-z]+[0-9]+[A-Za-z]+",
    r"^[0-9]+[A-Za-z]+",
    r"[A-Za-z]+[0-9]+$",
    r"[A-Za-z]+[;:][A-Za-z]+",
]
LEGAL_CITATIONS = [
    r"^[A-Z]{2,}\s+(?:SS|§)\s*\d+",
    r"^\w+\s+Law\s+(?:SS|§)\s*\d+",
    r"^\d+\s+[A-Z]+\s+\d+",
    r"^[A-Z]{2,}\s+\d+",
]
BOILERPLATE = [
    r"(?i)Verified\s+(?:Bill|Answer|Complaint|Petition)",
    r"(?i)Notice\s+of\s+Commencement",
    r"(?i)Cause\s+of\s+Action",
    r"(?i)Honorable\s+Court",
    r"(?i)Answering\s+Defendant",
]
CASE_NAMES = [r"^[A-Z][a-zA-Z]+\s+v\.?\s+[A-Z][a-zA-Z]+$"]
AREA_CODES = [
    r"^\d{5}(?:-\d{4})?$",
    r"^[A-Z]{2}\s+\d{5}$",
]
ADDRESSES = [
    r"(?i)\d+(?:st|nd|rd|th)\s+Floor",
    r"(?i)\b(?:Street|Drive|Avenue|Road|Lane|Court|Boulevard|Place|Way)\b",
    r"(?i)^\d+\s+[A-Z]",
]
FRAGMENTS = [
    r"(?i)^(?:SUPREME|CIVIL|FAMILY|DISTRICT)\s+COURT",
    r"(?i)^NOTICE\s+OF",
    r"(?i)Attorneys?\s+for\s+(?:Plaintiff|Defendant)",
    r"(?i)Services?\s+-\s+(?:Plaintiff|Defendant|None)",
    r"(?i)^(?:Plaintiff|Defendant)(?:'s)?$",
    r"(?i)^(?:FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+CAUSE",
    r"(?i)^\d+\s+of\s+\d+$",
]
#: Abbreviations of titles, which are no acronyms.
TITLE_LETTERS = "dr mr mrs ms md phd esq jr sr ii iii iv dds dvm od do rn lpn np pa pt ot cpa jd llm mba cfa pe ra".split()


def fits(x: Column, patterns: list[str], how: str = "search") -> Column:
    """Whether one of the patterns is found, or fits at the start (match) or the whole (full)."""
    form = {"search": "(?:{})", "match": "^(?:{})", "full": "^(?:{})$"}[how]
    found = F.lit(False)
    for p in patterns:
        flags, body = re.match(r"((?:\(\?[a-z]+\))?)(.*)", p, re.S).groups()
        found = found | x.rlike(flags + form.format(body))
    return found


def is_no_entity(x: Column) -> Column:
    """Too short or long, an address, a piece of a form, boilerplate, or the name of a case."""
    n = F.length(x)
    return (n < 3) | (n > 60) | fits(x, ADDRESSES) | fits(x, FRAGMENTS) | fits(x, BOILERPLATE) | fits(x, CASE_NAMES, "match")


def is_no_token(x: Column) -> Column:
    return fits(x, LEGAL_CITATIONS, "match") | fits(x, BOILERPLATE) | fits(x, CASE_NAMES, "match") | fits(x, AREA_CODES, "match") | fits(x, OCR_ERRORS)


def is_variation(x: Column) -> Column:
    return fits(F.lower(x), VARIATIONS, "match")


def is_acronym(x: Column) -> Column:
    return x.rlike("^[A-Z]{2,}$") & ~F.lower(x).isin(TITLE_LETTERS)


def entity_text(x: Column) -> Column:
    """An entity without joining words or punctuation at its ends."""
    t = F.regexp_replace(bare(x), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^(and/or|and|or)\s+", ""), r"(?i)\s+(and/or|and|or)$", "")
    return bare(F.regexp_replace(t, r"""^[.,;:!?()\[\]{}"'/\\]+|[.,;:!?()\[\]{}"'/\\]+$""", ""))


#: Words of organisations.
ORGANISATIONS = [
    "LLP", "PLLC", "P.C.", "LLC", "Inc", "Corp", "Corporation", "Law Firm", "Law Office", "Firm", "Hospital",
    "Medical", "Healthcare", "Health", "Clinic", "University", "College", "School", "Bank", "Insurance", "Services",
]


def looks_like_organisation(x: Column) -> Column:
    return F.lower(x).rlike("|".join(re.escape(w.lower()) for w in ORGANISATIONS))


def looks_like_person(x: Column) -> Column:
    """One to four words, each with a capital, none of an organisation."""
    w = F.filter(F.split(bare(x), r"\s+"), lambda p: p != "")
    return F.size(w).between(1, 4) & F.forall(w, lambda p: p.rlike(r"^\p{Lu}")) & ~looks_like_organisation(x)


def is_person(x: Column) -> Column:
    """A person flag in any of its forms: yes, true, 1, Person. Null and all else are none."""
    return F.coalesce(F.lower(bare(x.cast("string"))).isin("yes", "true", "1", "1.0", "person"), F.lit(False))


def consonant_run(x: Column) -> Column:
    """The longest run of consonants."""
    runs = F.regexp_extract_all(x, F.lit("[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def rake_text(x: Column) -> Column:
    """Without margin numbers, bare numbers and doubled white space."""
    t = F.regexp_replace(F.regexp_replace(x, r"(?md)^\s*\d{1,2}\s+", ""), r"\b\d+\b", "")
    return bare(F.regexp_replace(t, r"\s+", " "))


#: Words that a phrase may not begin with.
JUNK_STARTS = "the a an and or but of in on at to for".split()


def rake_phrase(x: Column, stopwords: list[str]) -> Column:
    """A phrase of 2 to 50 characters with a letter, without one weak word in front; null if it is none."""
    p = bare(x)
    rest = bare(F.regexp_replace(p, rf"(?i)^(?:{'|'.join(JUNK_STARTS)}) ", ""))
    bad = (F.length(p) < 2) | (F.length(p) > 50) | ~p.rlike("[a-zA-Z]") | (~F.contains(rest, F.lit(" ")) & F.lower(rest).isin(stopwords)) | (rest == "")
    return F.when(~bad, rest)


def phrase_count(phrase: Column, text: Column, letters: str = r"\p{L}\p{N}_") -> Column:
    """How often a phrase stands in a text between word boundaries, without regard to case.

    Words are of the class letters: what \\b takes for a word differs by engine and by version of Java.
    """
    low = F.lower(phrase)
    quoted = F.regexp_replace(low, r"([^\p{L}\p{N}_ ])", r"\\$1")
    # The phrase comes first, which Java then looks for by leaps; what stands before it is looked at from its end.
    before = F.when(low.rlike(f"^[{letters}]"), f"(?<![{letters}]").otherwise(f"(?<=[{letters}]")
    after = F.when(low.rlike(rf"[{letters}]\z"), f"(?![{letters}])").otherwise(f"(?=[{letters}])")
    empty = F.lit(f"(?<![{letters}])(?=[{letters}])|(?<=[{letters}])(?![{letters}])")
    return F.regexp_count(F.lower(text), F.when(low == "", empty).otherwise(F.concat(quoted, before, quoted, F.lit(")"), after)))


def word_phrases(text: Column, single: bool = True, doubled: bool = True) -> Column:
    """Every two ASCII words with one space between, each as often as a search for it alone meets it; with single also every word of letters.

    All is in small letters.  Two different words cannot meet themselves half-way, a doubled one can: three in a row hold it once.
    """
    low, begins, ends = F.lower(text), "(?<![a-z0-9_])", "(?![a-z0-9_])"
    find = lambda p, group: F.regexp_extract_all(low, F.lit(p), F.lit(group))
    out = [find(rf"{begins}(?=(([a-z]++) (?!\2{ends})[a-z]++){ends})[a-z]++", 1)]
    if single:
        out.append(find(f"{begins}[a-z]++{ends}", 0))
    if doubled:
        out.append(find(rf"{begins}([a-z]++) \1{ends}", 0))
    return F.concat(*out)


def one_hot_bins(count: Column) -> Column:
    """Five flags, one of them 1: 1, 2-3, 4-6, 7-20, 21 and more."""
    edges = [(None, 1), (2, 3), (4, 6), (7, 20), (21, None)]
    within = lambda a, b: (F.lit(True) if a is None else count >= a) & (F.lit(True) if b is None else count <= b)
    return F.array(*[within(a, b).cast("int") for a, b in edges])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def passages_for(pages: Column) -> Column:
    """Key passages for so many pages: one for every five, 5 to 15."""
    return F.least(F.greatest(F.floor(pages / 5), F.lit(5)), F.lit(15))


def case_id(names: Column, day: Column) -> Column:
    """An id for a set of file names and a date."""
    return F.concat(F.substring(F.md5(F.array_join(F.sort_array(names), "|")), 1, 8), F.lit("_"), F.date_format(day, "yyyyMMdd"))


def corpus_hash(files: Column) -> Column:
    """A hash of (name, time) pairs, in order of name; no files are ``empty``."""
    each = F.transform(F.sort_array(files), lambda f: F.concat_ws(":", f["name"], f["time"].cast("string")))
    return F.when(F.size(files) == 0, "empty").otherwise(F.md5(F.array_join(each, "|")))


def export_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm")
