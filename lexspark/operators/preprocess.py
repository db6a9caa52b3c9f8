"""The preprocessing chain: title and index pages, running headers, line numbers, page boundaries, transcript marks.

Each stage is a Column expression from text to text, so a chain of them is one
projection over the scan: nothing is shuffled and texts never leave their row.
Only the page-boundary stage, a walk along the text, runs in Python (Arrow
batches).  A null text stays null; the empty text stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.strings import let

TITLE_SCORE = 4
TITLE_PAGES = 3
#: Of texts longer than this, title pages may take at most half.
LARGE_TEXT = 10_000
INDEX_LINES = 10
INDEX_PERCENT = 30
INDEX_WINDOW = 50
#: Figures of the search for an index in texts without lines.
SHORTEST, TAIL_PART, TAIL_MOST, LINE_CHARS, CHAR_WINDOW = 1000, 10, 20_000, 60, 2000
HEADER_REPEATS = 3


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def title_pages(text: Column) -> Column:
    """Pages by form feeds, else by four line ends or a dashed rule; a long text without any is its head and the rest."""
    filled = lambda pages: F.filter(pages, lambda p: stripped(p) != "")
    parts = F.split(text, r"\n{4,}|\n\s*-{10,}\s*\n")
    head = F.array(F.substring(text, F.lit(1), F.lit(2000)), F.substring(text, F.lit(2001), F.length(text)))
    return F.when(text.contains("\f"), filled(F.split(text, "\f"))).when(F.size(parts) > 1, filled(parts)).when(F.length(text) > 3000, head).otherwise(F.array(text))


def without_title_pages(text: Column) -> Column:
    """Leading pages, three at most, go while they score as title pages; the first that does not ends it."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("chars"), F.lit(True).alias("on"))

    def step(a: Column, p: Column) -> Column:
        too_much = (F.length(text) > LARGE_TEXT) & ((a["chars"] + p["n"]) * 100 > 50 * F.length(text))
        on = a["on"] & (p["score"] >= TITLE_SCORE) & ~too_much
        return F.struct((a["k"] + on.cast("int")).alias("k"), (a["chars"] + F.when(on, p["n"]).otherwise(0)).alias("chars"), on.alias("on"))

    def kept(pages: Column) -> Column:
        first = F.transform(F.slice(pages, 1, TITLE_PAGES), lambda p: F.struct(T.title_score(p).alias("score"), F.length(p).alias("n")))
        left = let(F.aggregate(first, start, step, lambda a: a["k"]), lambda k: F.array_join(F.slice(pages, k + 1, F.greatest(F.size(pages) - k, F.lit(0))), "\n\n"))
        longest = F.array_max(F.transform(pages, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
        return F.when(F.size(pages) <= 1, text).otherwise(let(left, lambda x: F.when(stripped(x) == "", longest).otherwise(x)))

    return let(title_pages(text), kept)


def _index_density(lines: Column) -> Column:
    """(lines with text, index lines)"""
    filled = F.filter(lines, lambda x: stripped(x) != "")
    return F.struct(F.size(filled).alias("n"), F.size(F.filter(filled, T.is_index_line)).alias("k"))


def is_index_page(page: Column) -> Column:
    d = _index_density(F.split(page, "\n"))
    return (d["k"] >= INDEX_LINES) & (d["k"] * 100 >= INDEX_PERCENT * d["n"])


def _backwards(starts: Column, hit: Callable[[Column], Column], skip: Callable[[Column], Column]) -> Column:
    """The last of the starts, in their order, up to where a hit is followed by none; null without any hit. Skipped starts say nothing."""
    begin = F.struct(F.lit(None).cast("int").alias("at"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        here = hit(s)
        at = F.when(a["done"] | skip(s) | ~here, a["at"]).otherwise(s)
        return F.struct(at.alias("at"), (a["done"] | (~skip(s) & ~here & a["at"].isNotNull())).alias("done"))

    return F.aggregate(starts, begin, step, lambda a: a["at"])


def _index_line(text: Column) -> Column:
    """The line where an index at the end begins, found in half-overlapping windows from the end; null without any."""
    flags = F.transform(F.split(text, "\n"), lambda x: F.when(stripped(x) == "", 0).when(T.is_index_line(x), 2).otherwise(1))

    def found(flags: Column) -> Column:
        n = F.size(flags)
        starts = F.when(n >= INDEX_WINDOW, F.sequence(n - INDEX_WINDOW, F.lit(0), F.lit(-(INDEX_WINDOW // 2)))).otherwise(F.array().cast("array<int>"))
        count = lambda s, least: F.size(F.filter(F.slice(flags, s + 1, INDEX_WINDOW), lambda x: x >= least))
        hit = lambda s: (count(s, 2) >= INDEX_LINES) & (count(s, 2) * 100 >= INDEX_PERCENT * count(s, 1))
        return _backwards(starts, hit, lambda s: count(s, 1) < INDEX_LINES)

    return let(flags, found)


def _marks(t: Column, chars: Column) -> Column:
    """Index marks of a stretch of text by its lines, of a hundred; page references count half."""
    marks = F.regexp_count(t, F.lit(r"[A-Za-z]+\s*\(\d+\)")) + F.regexp_count(t, F.lit(r"\d{2,4}:\d{1,2}")) / 2
    return marks / F.greatest(F.floor(chars / LINE_CHARS), F.lit(1)) * 100


def _index_char(text: Column) -> Column:
    n = F.length(text)
    tail = F.least(F.floor(n / TAIL_PART).cast("int"), F.lit(TAIL_MOST))
    dense = (n >= SHORTEST) & (_marks(F.substring(text, n - tail + 1, tail), tail) >= INDEX_PERCENT)
    starts = F.when(dense & (n > CHAR_WINDOW), F.sequence(n - CHAR_WINDOW, F.lit(1), F.lit(-(CHAR_WINDOW // 2)))).otherwise(F.array().cast("array<int>"))
    return _backwards(starts, lambda s: _marks(F.substring(text, s + 1, F.lit(CHAR_WINDOW)), F.lit(CHAR_WINDOW)) >= INDEX_PERCENT, lambda s: F.lit(False))


def without_index_pages(text: Column) -> Column:
    """The first index page and all after it go; a text of one page is searched from its end, by lines or else by characters."""
    parts = F.when(text.contains("\f"), F.split(text, "\f")).otherwise(F.split(text, r"\n{4,}"))
    pages = F.when(F.size(parts) > 1, F.filter(parts, lambda p: stripped(p) != "")).otherwise(F.array(text))
    by_page = lambda p: let(F.array_position(F.transform(p, is_index_page), F.lit(True)).cast("int"), lambda first: F.when(first > 1, F.array_join(F.slice(p, F.lit(1), first - 1), "\n\n")).otherwise(text))
    lines = F.split(text, "\n")
    by_line = let(_index_line(text), lambda k: F.when(k.isNull(), text).when(k == 0, "").otherwise(F.array_join(F.slice(lines, F.lit(1), k), "\n")))
    by_char = let(_index_char(text), lambda k: F.when(k.isNull(), text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), k), r"\s+$", "")))
    return let(pages, lambda p: F.when(F.size(p) > 1, by_page(p)).when(F.size(lines) >= INDEX_LINES, by_line).otherwise(by_char))


def without_headers(text: Column, least: int = HEADER_REPEATS, custom: list[str] | None = None, short_lines: bool = True) -> Column:
    """Lines whose normal form repeats go, all of them, if one of them looks like a running header.

    The forms are sorted, so repeats are neighbours: linear in the lines but for the sort.
    """
    form = lambda x: T.header_form(stripped(x))
    often = lambda forms: F.array_distinct(F.array_compact(F.transform(forms, lambda f, i: F.when((f != "") & (F.get(forms, i + least - 1) == f), f))))

    def kept(lines: Column) -> Column:
        looks = F.array_distinct(F.transform(F.filter(lines, lambda x: T.is_header(x, custom, short_lines)), form))
        gone = F.array_intersect(let(F.sort_array(F.transform(lines, form)), often), looks)
        return let(gone, lambda g: F.when(F.size(g) == 0, text).otherwise(F.array_join(F.filter(lines, lambda x: ~F.array_contains(g, form(x))), "\n")))

    return let(F.split(text, "\n"), kept)


#: What a speaker's line begins with, and words of page headers.
SPEAKER = re.compile(r"(?:THE\s+COURT|MR\.|MS\.|MRS\.|Q\.|A\.|BY\s+MR\.|BY\s+MS\.)", re.IGNORECASE)
HEADER_WORDS = "proceedings court direct cross redirect recross examination continued voir dire colloquy summation argument".split()
LONGEST_RUN, CHAIN, GAP = 10, 3, 50
_RUN = re.compile(r"(?<!\d)1\s+2\s+3\s+")
_NUMBER = re.compile(r"(?<!\d)\d{1,4}(?!\d)")
_BEFORE = re.compile(r"([^\W\d_]+)[ \t]*\Z")
_AFTER = re.compile(r"[ \t]*(?:(\d+)|([^\W\d_]+))")


def number_runs(text: str) -> list[tuple[int, int]]:
    """Spans of line numbers that ran together: 1 2 3 and so on, to 5 at least; one or two with different ends need 10."""
    found = []
    for m in _RUN.finditer(text):
        last, at = 3, m.end()
        while n := re.compile(rf"[ \t]*{last + 1}(?!\d)").match(text, at):
            last, at = last + 1, n.end()
        if last >= 5:
            found.append((m.start(), at, last))
    if len({x[2] for x in found}) > 2 and len(found) < 3:
        found = [x for x in found if x[2] >= LONGEST_RUN]
    return [x[:2] for x in found]


def page_numbers(text: str) -> list[tuple[int, int]]:
    """Spans of the longest chain of numbers that each follow the one before by 1, if it is long and its numbers far apart."""
    found = [(m.start(), m.end(), int(m[0])) for m in _NUMBER.finditer(text) if 2 <= int(m[0]) <= 5000]
    # From the end: the next number up is the nearest one behind, so a chain's length is known from its second link.
    length, follows, nearest = [1] * len(found), [-1] * len(found), {}
    for k in range(len(found) - 1, -1, -1):
        if (then := nearest.get(found[k][2] + 1)) is not None:
            length[k], follows[k] = length[then] + 1, then
        nearest[found[k][2]] = k
    if max(length, default=0) < CHAIN:
        return []
    k, chain = length.index(max(length)), []
    while k >= 0:
        chain.append(found[k][:2])
        k = follows[k]
    return chain if (chain[-1][0] - chain[0][0]) / (len(chain) - 1) >= GAP else []


def _debris(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of a page number with the initials and header words around it."""
    while (m := _BEFORE.search(text, max(0, start - 80), start)) and ((len(m[1]) <= 3 and m[1].islower()) or m[1].lower() in HEADER_WORDS):
        start = m.start()
    while m := _AFTER.match(text, end):
        at = m.start(m.lastindex)
        if SPEAKER.match(text, at) or not (int(m[1]) <= 30 if m[1] else m[2].lower() in HEADER_WORDS):
            break
        end = m.end()
    return start, end


def page_boundaries(text: str) -> str:
    """A text without run-together line numbers, page numbers, and the debris around these."""
    for a, b in reversed(number_runs(text)):
        text = text[:a] + text[b:]
    spans: list[list[int]] = []
    for a, b in sorted(_debris(text, *x) for x in page_numbers(text)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in reversed(spans):
        text = text[:a] + " " + text[b:]
    return text


@F.pandas_udf(StringType())
def without_page_boundaries(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else page_boundaries(t))


def without_standalone_numbers(text: Column) -> Column:
    """Lines that hold a number of their own go, if these rise through the text in steps of 3 at most and are 3 at least."""
    number = lambda x, i: F.when(x.rlike(r"^\s*\d{1,18}\s*$"), F.struct(stripped(x).cast("long").alias("n"), i.alias("i")))
    other = lambda order, k, x: F.coalesce(F.get(order, k)["n"] != x["n"], F.lit(True))
    alone = lambda order: F.filter(order, lambda x, k: ((k == 0) | other(order, k - 1, x)) & other(order, k + 1, x))
    rises = lambda own: F.forall(F.transform(own, lambda x, k: (k == 0) | ((F.get(own, k - 1)["i"] < x["i"]) & (x["n"] - F.get(own, k - 1)["n"] <= 3))), lambda ok: ok)

    def kept(lines: Column, own: Column) -> Column:
        left = let(F.transform(own, lambda x: x["i"]), lambda gone: F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
        return F.when((F.size(own) >= 3) & rises(own), left).otherwise(text)

    return let(F.split(text, "\n"), lambda lines: let(let(F.sort_array(F.array_compact(F.transform(lines, number))), alone), lambda own: kept(lines, own)))


#: References of a concordance inside a text; the word before stays.
CITATIONS = [
    r"(?U)\b(\w+)\s*\(\d+\)\s*(?:\d{2,4}:\d{1,2}[;,\s]*)+",
    r"(?U)\b([A-Z][a-z]+)\s+\d{2,4}:\d{1,2}(?:[;,]\s*\d{2,4}:\d{1,2})*",
]


def without_citations(text: Column) -> Column:
    for pattern in CITATIONS:
        text = F.regexp_replace(text, pattern, "$1")
    return text


def single_spaced(text: Column) -> Column:
    """One empty line and one space at most, no white space at the ends of lines or of the text."""
    t = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " ")
    return stripped(F.regexp_replace(t, r"(?m)^[^\S\n]+|[^\S\n]+$", ""))


def transcript(text: Column) -> Column:
    return single_spaced(without_citations(without_standalone_numbers(text)))


#: The stages in order, by name.
STAGES: dict[str, Callable[[Column], Column]] = {
    "title_pages": without_title_pages,
    "index_pages": without_index_pages,
    "headers_footers": without_headers,
    "line_numbers": T.without_line_numbers,
    "page_boundaries": without_page_boundaries,
    "transcript_artifacts": transcript,
}


def default_stages(settings: dict | None = None) -> list[str]:
    """The names of the stages to run. Title pages go only with title_page_handling = exclude_all; others can be turned off by name."""
    s = settings or {}
    on = {"title_pages": s.get("title_page_handling") == "exclude_all"}
    return [k for k in STAGES if on.get(k, bool(s.get(f"preprocess_{k}", True)))]


def preprocessed(docs: DataFrame, text: str = "text", stages: list[str] | None = None, stats: str | None = None) -> DataFrame:
    """docs with text cleaned by the stages in order; column stats, if named, gets the characters that each removed."""
    names = default_stages() if stages is None else stages
    if unknown := [n for n in names if n not in STAGES]:
        raise ValueError(f"no such stage: {unknown}")
    now, lengths = F.col(text), []
    out = docs
    for k, name in enumerate(names):
        step = f"__stage_{k}"
        out = out.withColumn(step, STAGES[name](now))
        lengths += [F.lit(name), F.length(now) - F.length(step)]
        now = F.col(step)
    if stats:
        out = out.withColumn(stats, F.create_map(*lengths) if lengths else F.lit(None).cast("map<string,int>"))
    kept = [now.alias(c) if c == text else F.col(c) for c in docs.columns if c != stats]
    return out.select(*kept, *([stats] if stats else []))


def combined(docs: DataFrame, by: str, order: str, name: str | None = None, text: str = "text", separator: str = "\n\n---\n\n") -> DataFrame:
    """(by, text): the texts of a group, in order, joined; with name, each under a heading. A group is one result row, as its reader wants it."""
    t = F.col(text) if name is None else F.concat(F.lit("--- "), F.col(name).cast("string"), F.lit(" ---\n"), F.col(text))
    g = docs.where(F.col(text).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), t.alias("t")))).alias("parts"))
    return g.select(by, F.array_join(F.transform("parts", lambda x: x["t"]), separator).alias("text"))
