"""Token counts by a map-side two-tier lookup.

A pre-token here is a run of characters without ASCII white space; the library's
own pre-tokenizer never joins characters across white space, so a text has as
many tokens as its pre-tokens together.  Tier one is a broadcast table of the
lengths of frequent pre-tokens, at most ``frequent`` of them, from a random sample of
about ``sample_rows`` documents (it only saves work; any other table gives the
same counts): each task of the sample sends its commonest pre-tokens, SENT of all
tasks together at most, and the driver adds them up.  Tier two is a cache in each worker, kept from task to task, that
takes no more at ``cached`` entries; what it lacks is encoded by the library.  No pre-token is
shuffled, not even one of the sample, and no row moves.  Texts come in batches
bounded in bytes, so that a very long one stands alone; other columns are not read.

Vocabularies whose tokens span white space must not use this operator: the
tokenizer file is checked for one that drops white space.  Special strings in a
text count as the library's default has it.  Null and empty texts have 0 tokens.
Repeated rows and null ids are counted like any other row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held

LIMIT = 2048
FREQUENT = 50_000
SAMPLE_ROWS = 2_000
CACHED = 500_000
#: Characters of an entry of the first tier.
LONGEST = 64
#: Entries that the sample's tasks send to the driver, about.
SENT = 400_000
_GAPS = re.compile(r"[\x20\x09-\x0D]+")


def drops_white_space(path: str) -> bool:
    """Whether the pre-tokenizer cuts at white space and drops it."""
    spec = json.load(open(path, encoding="utf-8"))
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s" in first.get("pattern", {}).get("Regex", "")
    joins = any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return not joins and bool(split or first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"))


def _lengths(tokenizer, pre: list[str]) -> list[int]:
    return [len(x) for x in tokenizer.encode_batch_fast(pre, add_special_tokens=False)]


def frequent_lengths(docs: DataFrame, tokenizer_file: str, text: str = "text", frequent: int = FREQUENT, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Tier one. Each task of the sample sends its commonest pre-tokens only."""
    from tokenizers import Tokenizer

    few = docs.select(F.col(text).cast("string").alias("t")).sample(min(1.0, sample_rows / max(1, docs.count())), seed=7)
    most = min(frequent, max(100, SENT // max(1, few.rdd.getNumPartitions())))

    def common(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for part in parts:
            for t in part["t"]:
                n.update(x for x in _GAPS.split(t) if 0 < len(x) <= LONGEST) if t else None
        if top := n.most_common(most):
            yield pd.DataFrame({"w": [x[0] for x in top], "n": [x[1] for x in top]})

    total: Counter[str] = Counter()
    for r in few.mapInPandas(common, "w string, n long").toLocalIterator():
        total[r.w] += r.n
    pre = sorted(sorted(total), key=total.__getitem__, reverse=True)[:frequent]
    return dict(zip(pre, _lengths(Tokenizer.from_file(tokenizer_file), pre))) if pre else {}


def count(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, frequent: int = FREQUENT, cached: int = CACHED) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""
    if not drops_white_space(tokenizer_file):
        raise ValueError(f"{tokenizer_file}: its tokens may span white space")
    bounded_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_file, text, frequent))
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        key = hashlib.sha256(spec.value.encode()).digest()
        tokenizer, cache = held(key, lambda: (Tokenizer.from_str(spec.value), {}))
        first = table.value
        for part in parts:
            split = [_GAPS.split(t) if t else [] for t in part["t"]]
            words: set[str] = set().union(*split)
            words.discard("")
            new = [w for w in words if w not in first and w not in cache]
            fresh: dict[str, int] = {}
            for k in range(0, len(new), 10_000):
                fresh.update(zip(new[k : k + 10_000], _lengths(tokenizer, new[k : k + 10_000])))
            both = {w: first[w] if w in first else cache[w] if w in cache else fresh[w] for w in words} | {"": 0}
            if len(cache) + len(fresh) <= cached:
                cache.update(fresh)
            n = [sum(map(both.__getitem__, ws)) for ws in split]
            yield pd.DataFrame({"doc_id": part["doc_id"], "has_id": part["has_id"], "n_bytes": part["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    # Numbers with nulls would pass through floats in pandas: a missing id is a flag.
    number = F.col(key).cast("long")
    d = docs.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNotNull().alias("has_id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    out = d.mapInPandas(run, "doc_id long, has_id boolean, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
