"""Substring dedup by line or paragraph hashing.

Units are lines, and paragraphs (between blank lines) of several lines, so that
a passage is found however it is wrapped; one parameter leaves only the lines or
only the paragraphs.  They are normalised: Unicode NFKC, lower case, white space
runs as one space, no punctuation at either end.  Equal 128-bit digests are
equal units.  Over all documents the occurrence with the smallest (id, offset)
stays, all others are removed, each with its offsets in the original text (code
points, end exclusive).  Units of every length count, single words too; those
without a letter or digit are none.  Lines inside a repeated paragraph that are
repeats themselves have rows of their own.

Passages are what repeats at length: runs of neighbouring units, lines and apart
from them the sentences of a paragraph (so that a passage is found inside longer
lines too), each of which occurs elsewhere as well, of over ``passage_words``
words in different units together.  As the sentences at its ends run on into the
text around it, a passage of 50 words keeps some 35 in whole units, which the
default allows for.  Short boilerplate between own text is no passage.  Every
occurrence of their units is reported, the earliest ones as not removed.  Their
digests have 64 bits, as a run needs several neighbours that meet by chance.

Digests are summed up before the shuffle; a unit that a third of all documents
hold is one row for each task.  Its occurrences meet that row in a join that
adaptive execution splits.  Null and empty texts have no units.  Null ids rank
last.  Rows of equal id and offset are the same occurrence.  A very long text is
cut by the one task that holds it.  Other columns stay as they are, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, neutral, stored

MIN_WORDS = 1
#: Words in whole units that a passage exceeds.
PASSAGE = 32
NO_ID = 2**63 - 1
UNIT = "doc_id long, start long, end long, n_words int, digest binary"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normalised(unit: str) -> str:
    t = unit if unit.isascii() else unicodedata.normalize("NFKC", unit)
    return _EDGES.sub("", " ".join(t.lower().split()))


def cut(text: str, paragraphs: bool | None) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text: lines or paragraphs, or (None) lines and those paragraphs that hold several."""
    if paragraphs is None:
        yield from cut(text, False)
        for s, e in cut(text, True):
            # a paragraph with one line of words is that line, whatever rules stand around it
            if "\n" in text[s:e] and sum(1 for line in text[s:e].split("\n") if normalised(line)) > 1:
                yield s, e
        return
    if paragraphs:
        at = 0
        for m in re.finditer(r"\n(?:[^\S\n]*\n)+", text):
            yield at, m.start()
            at = m.end()
        yield at, len(text)
        return
    at = 0
    for line in text.split("\n"):
        yield at, at + len(line)
        at += len(line) + 1


def units(docs: DataFrame, text: str = "text", key: str = "doc_id", paragraphs: bool | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part["doc_id"], part["text"]):
                for s, e in cut(t, paragraphs) if t else ():
                    unit = normalised(t[s:e])
                    if unit and (n := unit.count(" ") + 1) >= min_words:
                        rows.append((k, s, e, n, hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "n_words", "digest"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, UNIT)


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", paragraphs: bool | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words, digest, kept_doc, kept_start for each unit to remove."""
    u = stored(units(docs, text, key, paragraphs, min_words), "units")
    first = u.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("digest", F.col("first.doc_id").alias("kept_doc"), F.col("first.start").alias("kept_start")), "unit-firsts")
    out = u.join(first, "digest").where("doc_id <> kept_doc or start <> kept_start")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), "start", "end", "n_words", F.hex("digest").alias("digest"), real("kept_doc"), "kept_start")


_GAP = re.compile(r"\n(?:[^\S\n]*\n)+")
_STOP = re.compile(r"[.!?]+[\"')\]\u201d\u2019]*\s+")
LINES, SENTENCES = 0, 1
PART = "doc_id long, row long, level int, pos int, start int, end int, n_words int, digest long"


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of every paragraph; a line end within a paragraph ends none."""
    at = 0
    for stop in [*(m.span() for m in _GAP.finditer(text)), (len(text), len(text))]:
        for m in _STOP.finditer(text, at, stop[0]):
            yield at, m.end()
            at = m.end()
        yield at, stop[0]
        at = stop[1]


def _parts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in PART.split(", ")]
    for part in parts:
        rows = []
        for k, row, t in zip(part["doc_id"].tolist(), part["row"].tolist(), part["text"]):
            for level, spans in ((LINES, cut(t, False)), (SENTENCES, sentences(t))) if t else ():
                pos = 0
                for s, e in spans:
                    if unit := normalised(t[s:e]):
                        rows.append((k, row, level, pos, s, e, unit.count(" ") + 1, xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass")) - (1 << 63)))
                        pos += 1
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _runs(least: int):
    """The units of runs of at least so many words in different units; rows come sorted by document, level and position."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            where = part[["doc_id", "row", "level"]].to_numpy()
            new = np.append(True, (where[1:] != where[:-1]).any(axis=1) | (np.diff(part["pos"].to_numpy()) > 1)) if len(part) else np.zeros(0, bool)
            run_of = np.cumsum(new)
            last = int(np.flatnonzero(new)[-1]) if len(part) else 0
            rest = part.iloc[last:]
            yield from kept(part.iloc[:last], run_of[:last])
        if rest is not None:
            yield from kept(rest, np.zeros(len(rest), np.int64))

    def kept(part: pd.DataFrame, run_of: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(part):
            unit = pd.DataFrame({"r": run_of, "d": part["digest"].to_numpy()})
            words = np.bincount(run_of, part["n_words"].to_numpy() * ~unit.duplicated().to_numpy())
            if (long := words[run_of] > least).any():
                yield part[long]

    return run


def passages(docs: DataFrame, text: str = "text", key: str = "doc_id", passage_words: int = PASSAGE) -> DataFrame:
    """doc_id, start, end, n_words, digest, first_doc, removed for each occurrence of a unit of a repeated passage.

    first_doc holds its first occurrence, by (id, offset), which has removed = false.
    """
    bounded_batches(docs.sparkSession)
    t = F.col(text).cast("string")
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(t).alias("row"), t.alias("text"))
    u = stored(d.mapInPandas(_parts, PART), "passage-units")
    ends = u.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("start").alias("a"), F.max("start").alias("z"), F.min(F.struct("doc_id", "start"))["start"].alias("first_start"))
    # A sentence may be a line: one occurrence on two levels is none elsewhere.
    first = stored(ends.where("first_doc <> last_doc or a <> z").select("digest", "first_doc", "first_start"), "passage-firsts")
    again = u.join(first, "digest").repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "level", "pos")
    found = again.select(*[x.split()[0] for x in PART.split(", ")], "first_doc", "first_start").mapInPandas(_runs(passage_words), f"{PART}, first_doc long, first_start int")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    removed = (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    return found.select(real("doc_id"), "start", "end", "n_words", F.hex("digest").alias("digest"), real("first_doc"), removed.alias("removed"))


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id", paragraphs: bool | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated units cut out of their texts and their offsets in column removed (an own column of that name is replaced)."""
    d, (t, k), back = neutral(docs, text, key)
    spans = repeats(docs, text, key, paragraphs, min_words).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    spans = stored(spans.withColumnRenamed("doc_id", "r_doc"), "unit-spans")
    out = d.join(spans, d[k].cast("long").eqNullSafe(spans["r_doc"]), "left").drop("r_doc")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        new = []
        for t, cuts in zip(texts, spans):
            at, keep = 0, []
            for x in cuts if cuts is not None and t is not None else ():
                keep.append(t[at : x["start"]])
                at = max(at, min(len(t), x["end"] + 1))  # with the line end; units may lie inside each other
            new.append(t if t is None else "".join(keep) + t[at:])
        return pd.Series(new)

    return back(out.withColumn(t, without(F.col(t), F.col("removed"))), "removed")
