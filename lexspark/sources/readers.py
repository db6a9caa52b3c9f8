"""Files into tables: (path, text, status, method, confidence, page_count, error).

``binaryFile`` lists and reads on the cluster; formats without a Spark reader
are decoded from the bytes in Arrow batches.  Files over the size limit, of
unknown kinds, or that cannot be decoded become rows with status ``error``.
PDF and image files need a provider: a function from bytes to text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffixes read, and size limits in bytes.
SUFFIXES = ["pdf", "txt", "rtf", "docx", "png", "jpg", "jpeg"]
TOO_LARGE = 500 * 1024 * 1024
SCHEMA = "path string, text string, status string, method string, confidence int, page_count int, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def rtf_text(raw: bytes) -> str:
    """The visible text of an RTF file: groups, control words and hex characters resolved."""
    t = raw.decode("latin-1")
    out, skip, stack, at = [], False, [], 0
    hidden = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer")
    while at < len(t):
        c = t[at]
        if c == "{":
            stack.append(skip)
        elif c == "}":
            skip = stack.pop() if stack else False
        elif c == "\\":
            if m := re.match(r"\\'([0-9a-fA-F]{2})", t[at:]):
                if not skip:
                    out.append(bytes.fromhex(m[1]).decode("cp1252", "replace"))
                at += 4
                continue
            if m := re.match(r"\\u(-?\d+) ?\??", t[at:]):
                if not skip:
                    out.append(chr(int(m[1]) % 65536))
                at += m.end()
                continue
            if m := re.match(r"\\([a-zA-Z]+)(-?\d+)? ?", t[at:]):
                if m[1] in hidden:
                    skip = True
                elif not skip:
                    out.append({"par": "\n", "line": "\n", "tab": "\t", "page": "\f"}.get(m[1], ""))
                at += m.end()
                continue
            at += 1
            if at < len(t) and t[at] == "*":
                skip = True
            elif at < len(t) and t[at] in "\\{}" and not skip:
                out.append(t[at])
        elif c not in "\r\n" and not skip:
            out.append(c)
        at += 1
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def docx_text(raw: bytes) -> str:
    """Paragraphs that are not blank, then the rows of tables with cells joined by bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_WORD}body")
    said = lambda e: "".join(x.text or "" for x in e.iter(f"{_WORD}t"))
    lines = [s for p in body.findall(f"{_WORD}p") if (s := said(p)).strip()]
    for row in body.iter(f"{_WORD}tr"):
        lines.append(" | ".join(said(c).strip() for c in row.findall(f"{_WORD}tc")))
    return "\n".join(lines)


def read_files(spark: SparkSession, path: str, providers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """One row for each file below path, sub-folders included."""
    readers = {"txt": lambda b: b.decode("utf-8", "ignore"), "rtf": rtf_text, "docx": docx_text, **(providers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select("path", "length", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind"), F.when(F.col("length") <= TOO_LARGE, F.col("content")).alias("content"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, n, kind, raw in zip(part["path"], part["length"], part["kind"], part["content"]):
                read = readers.get(kind)
                if read is None or raw is None:
                    why = f"file of {n} bytes is over the limit" if raw is None else f"no reader for .{kind}"
                    rows.append((p, None, "error", None, 0, 0, why))
                    continue
                try:
                    text = read(bytes(raw))
                    rows.append((p, text, "success", "direct_read" if kind == "txt" else kind, 100 if kind == "txt" else 90, text.count("\f") + 1, None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((p, None, "error", kind, 0, 0, str(e)[:300]))
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word and count from tab-separated lines; malformed lines are dropped."""
    raw = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema("term string, n long").csv(path)
    return raw.where("term is not null and n is not null").groupBy(F.lower("term").alias("term")).agg(F.sum("n").alias("n"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a list, lower-cased, without blanks and comments."""
    t = spark.read.text(path).select(F.lower(F.btrim("value")).alias("term"))
    return t.where("term <> '' and not startswith(term, '#')").distinct()


def cid_ratio(text):
    """The share of words that are unmapped glyphs, (cid:7), of a text."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.size(F.filter(w, lambda x: x.rlike(r"\(cid:\d+\)"))) / F.greatest(F.size(w), F.lit(1))


def best_of(texts: DataFrame) -> DataFrame:
    """One text for each path: that of higher confidence, the first reader's on ties. texts: (path, reader, text, confidence)."""
    return texts.groupBy("path").agg(F.max_by(F.struct("reader", "text", "confidence"), F.struct("confidence", -F.col("reader"))).alias("b")).select("path", "b.*")
