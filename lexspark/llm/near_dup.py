"""Near-duplicate detection by ProbMinHash.

Texts are lower-cased and cut into words; shingles of five words weigh as often
as they occur (a shorter text is one shingle).  Copies that agree word for word
are one node, found by a 128-bit digest.  For each node the shingles emit a
Poisson process at the rate of their weight, each arrival falling on one of M
components; a component keeps its first arrival, and a shingle stops once its
clock passes the last of these (early termination).  Two nodes agree in a
component with the probability Jaccard of their weights.  BANDS bands of
M / BANDS components each make buckets.

Candidates come from the buckets without listing all pairs of a bucket:

1. each node meets the bucket's leader; pairs of exact similarity of at least
   ``similarity`` are links, connected links are classes;
2. where a bucket still holds several classes, pairs of different classes are
   compared by signature in blocks of BLOCK nodes, so a bucket of any size is
   done whole by many tasks; those within reach of the threshold are verified
   there, each in the first band that it shares, and a block puts out only the
   links that join classes.

A pair at similarity 0.8 meets in a bucket with probability 0.9999.  Step 1 loses
no pair that meets its leader; step 2 loses a pair at exactly 0.8 with probability
0.0002, as its signature may agree in less than the reach of 80 components of 120
(at 0.82 that is 0.00002); links of either step come from the exact similarity of
all shingles, as 64-bit hashes.

Tables that clash in names lose none: columns are read by position.  A very long
text is one row of hashes.  Null and empty texts have no words and form one class.  A null id is the
largest; a class is named after its smallest id.  Repeated rows are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held, neutral, small, stored, words

SHINGLE = 5
SIMILARITY = 0.8
M = 120
BANDS = 24
BLOCK = 1024
#: So many edges at most are left to one task, which holds about 100 bytes of each.
LAST_EDGES = 200_000
#: Ids are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: str) -> Column:
    """Hashes of the shingles of the word hashes w, in order, with repeats."""
    at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    short = F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), at)
    return F.when(F.size(w) >= SHINGLE, many).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))


def _read(docs: DataFrame, text: str, key: str) -> DataFrame:
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("n_text"))
    d = d.withColumn("n_words", words(F.lower("n_text"))).withColumn("n_h", F.transform("n_words", lambda x: F.xxhash64(x)))
    return d.withColumns({"node": F.unhex(F.md5(F.array_join("n_words", " "))), "text_hash": F.xxhash64("n_text"), "shingles": shingles("n_h")})


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """ProbMinHash signatures (docs x m); doc ascends, elements of a doc differ. A doc without elements is all 0."""
    best, sig = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    n = np.bincount(doc, minlength=docs)
    alone = n[doc] == 1  # one element wins every component
    sig.reshape(docs, m)[doc[alone]] = element[alone, None]
    e, w, d = element[~alone], weight[~alone], doc[~alone]
    clock, last, step = np.zeros(len(e)), np.full(docs, np.inf), 0
    while len(e):
        r = _mix(e + np.uint64((step + 1) * int(_GOLD) & (2**64 - 1)))
        clock = clock - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / w
        go = clock < last[d]
        e, w, d, clock, r = e[go], w[go], d[go], clock[go], r[go]
        at = d * m + (_mix(r ^ _GOLD) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, at, clock)
        won = best[at] == clock
        sig[at[won]] = e[won]
        if len(d) and (step < 8 or step % 8 == 0):
            some = d[np.concatenate([[True], d[1:] != d[:-1]])]
            last[some] = best.reshape(docs, m)[some].max(axis=1)
        step += 1
    return sig.reshape(docs, m)


def weighted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different elements, their counts, and the index of their list."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    if not len(flat):
        return flat, np.zeros(0), doc
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    return flat[at], np.diff(np.append(at, len(flat))).astype(np.float64), doc[at]


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact, for two lists of shingles with repeats: sum over common x of 1 / sum over y of max(a_y / a_x, b_y / b_x)."""
    return _jaccard(*np.unique(a, return_counts=True), *np.unique(b, return_counts=True))


def _jaccard(x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray) -> float:
    """The same, for different elements in order with their counts."""
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return float(not len(x) and not len(y))
    if xn.max() == 1 and yn.max() == 1:
        return len(both) / (len(x) + len(y) - len(both))
    u, v = xn[i].astype(float), yn[j].astype(float)
    ratio = u / v
    order = np.argsort(ratio, kind="stable")
    # An element counts by a where its ratio is above that of x, else by b; elements of one side only always count.
    above = np.append(np.cumsum(u[order][::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(v[order]))
    cut = np.searchsorted(ratio[order], ratio, side="right")
    total = (above[cut] + xn.sum() - u.sum()) / u + (below[cut] + yn.sum() - v.sum()) / v
    return float((1 / total).sum())


def _signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held()  # what other operators keep in this worker
    for part in parts:
        for s in range(0, len(part), 2000):
            p = part.iloc[s : s + 2000]
            sig = signatures(*weighted(list(p["shingles"])), len(p))
            rows = M // BANDS
            key = np.zeros((len(p), BANDS), np.uint64)
            for k in range(rows):
                key = _mix(key * _GOLD + sig[:, k::rows])
            key = _mix(key ^ np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)
            short = (sig >> np.uint64(32)).astype(np.uint32)
            filled = np.array([len(x) > 0 for x in p["shingles"]], bool)
            yield pd.DataFrame({
                "doc_id": p["doc_id"], "has_id": p["has_id"], "node": p["node"], "text_hash": p["text_hash"],
                "bands": [k if f else k[:0] for k, f in zip(key, filled)], "sig": [x.tobytes() for x in short],
            })


def signed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    bounded_batches(docs.sparkSession)
    d = _read(docs, text, key)
    # Numbers with nulls would pass through floats in pandas: a missing id is a flag.
    d = d.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "node", "text_hash", "shingles")
    out = d.mapInPandas(_signed, "doc_id long, has_id boolean, node binary, text_hash long, bands array<long>, sig binary")
    return out.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")


def _least(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, to) for every node of a few edges: to is one node of its component."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}), *parts], ignore_index=True)
    code, node = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    a, b = code[: len(edges)], code[len(edges) :]
    up, before = np.arange(len(node)), None
    while before is None or (up != before).any():
        before = up.copy()
        least = np.minimum(up[a], up[b])
        np.minimum.at(up, a, least)
        np.minimum.at(up, b, least)
        np.minimum.at(up, before, up)  # what hangs below a root that moved comes along
        up = up[up]
    if len(node):
        yield pd.DataFrame({"id": node, "to": node[up]})


def components(edges: DataFrame, last: int = LAST_EDGES) -> DataFrame:
    """(node, root) for every end of the edges (a, b).

    Each round, nodes move to their least neighbour in a new random order, which leaves fewer edges; the last ones go to one task.
    """
    e = stored(edges.where("a <> b").distinct(), "edges")
    roots = stored(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    step = 0
    while n := e.count():
        if n <= last:
            to = stored(e.coalesce(1).mapInPandas(_least, "id binary, to binary"), "moves")
            return stored(roots.join(to, F.col("root") == F.col("id"), "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        rank = lambda c, s=step: F.struct(F.xxhash64(F.lit(s), F.col(c)), F.col(c).alias("id"))
        ends = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = ends.groupBy("a").agg(F.min(rank("b")).alias("least"))
        to = stored(to.select(F.col("a").alias("id"), F.least("least", rank("a"))["id"].alias("to")), "moves")
        roots = stored(roots.join(to, F.col("root") == F.col("id"), "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        e = e.join(to, F.col("a") == F.col("id")).select(F.col("to").alias("a"), "b")
        e = e.join(to, F.col("b") == F.col("id")).select("a", F.col("to").alias("b")).where("a <> b")
        e = stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        step += 1
    return roots


def _similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        s = [probability_jaccard(np.asarray(x), np.asarray(y)) for x, y in zip(part["left"], part["right"])]
        yield pd.DataFrame({"a": part["a"], "b": part["b"], "similarity": s})


def shingled(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """(node, s): the shingles of the wanted nodes, whose texts are read again."""
    ids = stored(nodes.select("node", "rep").join(wanted, "node", "left_semi"), "asked")
    has = small(ids.select(F.col("rep").alias("rep_id")).distinct(), BROADCAST_IDS)
    d = docs.join(has, docs[key].cast("long").eqNullSafe(has["rep_id"]), "left_semi")
    d = _read(d, text, key).select("node", F.col("shingles").alias("s"))
    return d.join(ids.select(F.col("node").alias("asked")), F.col("node") == F.col("asked"), "left_semi").select("node", "s").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, key: str, similarity: float) -> DataFrame:
    """Links among pairs (a, b), by the exact similarity of their texts."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = stored(shingled(wanted, docs, nodes, text, key), "asked-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("s").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("s").alias("right")), "b")
    links = both.mapInPandas(_similar, "a binary, b binary, similarity double")
    return stored(links.where(F.col("similarity") >= similarity), "links")


def _across(similarity: float):
    reach = int(M * similarity - 3.5 * np.sqrt(M * similarity * (1 - similarity)))

    def links_of(g: pd.DataFrame) -> Iterator[tuple[int, int]]:
        """Links between different classes, only as many as join classes. Each pair is looked at in the first band that it shares."""
        sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), M)
        root, band = pd.factorize(g["root"])[0], int(g["band"].iloc[0])
        own, low, high = g["own"].to_numpy(), g["low"].iloc[0], g["high"].iloc[0]
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        lists = [np.unique(np.asarray(x), return_counts=True) for x in g["s"]]
        up = list(range(int(root.max()) + 1))

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for i in one:
            other = two[(root[two] != root[i]) & ((low != high) | (two > i))]
            same = sig[other] == sig[i]
            first = same.reshape(len(other), BANDS, M // BANDS).all(axis=2).argmax(axis=1)
            n = same.sum(axis=1)
            at = np.flatnonzero((n >= reach) & (first == band))
            for k in at[np.argsort(-n[at], kind="stable")]:
                j = other[k]
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y and _jaccard(*lists[i], *lists[j]) >= similarity:
                    up[x] = y
                    yield i, j

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            cut = part[["bucket", "low", "high"]].to_numpy()
            new = np.flatnonzero((cut[1:] != cut[:-1]).any(axis=1)) + 1
            starts = [0, *new]
            for s, t in zip(starts, starts[1:]):
                yield from made(part.iloc[s:t])
            rest = part.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield from made(rest)

    def made(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if g["root"].nunique() < 2:
            return
        node = g["node"].tolist()
        if found := list(links_of(g)):
            yield pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]})

    return run


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, node, class_id and class_node for each row of docs."""
    docs, (text, key), _ = neutral(docs.select(text, key), text, key)
    rows = stored(signed(docs, text, key), "signatures")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    b = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    lead = b.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node"), F.col("node").alias("id")))["id"].alias("leader")).where("n > 1")
    shared = stored(b.join(stored(lead, "leaders"), "bucket"), "buckets")
    pairs = stored(shared.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")
    links = verified(pairs, docs, nodes, text, key, similarity).select("a", "b")
    roots = components(links)

    # Buckets that still hold several classes.
    member = shared.join(roots, "node", "left").select("bucket", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    member = stored(member, "members")
    mixed = member.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cross = stored(member.join(stored(mixed, "mixed"), "bucket"), "cross")
    texts = shingled(cross.select("node").distinct(), docs, nodes, text, key)
    cross = cross.join(stored(texts.join(nodes.select("node", "sig"), "node"), "cross-texts"), "node")
    cross = cross.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cross = cross.select("bucket", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "sig", "s")
    cross = cross.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    more = stored(cross.mapInPandas(_across(similarity), "a binary, b binary"), "cross-links")
    if more.limit(1).count():
        roots = components(links.union(more))

    rooted = stored(nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("f"))
    first = stored(first.select("root", F.col("f.rep").alias("class_id"), F.col("f.node").alias("class_node")), "class-firsts")
    named = stored(rooted.join(first, "root").select("node", "class_id", "class_node"), "class-names")
    return rows.select("doc_id", "text_hash", "node").join(named, "node")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the smallest id (of its copies with that id, the smallest text hash)."""
    docs, (text, key), back = neutral(docs, text, key)
    c = stored(classes(docs, text, key, similarity), "classes")
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    marked = c.groupBy("class_node", "node", "doc_id", "text_hash").agg(F.count("*").alias("n"), F.min(keeps).alias("keeps"))
    first = marked.where("keeps").groupBy("class_node").agg(F.min("text_hash").alias("first_hash"))
    marked = stored(marked.join(stored(first, "class-hash"), "class_node", "left"), "marked")
    stays = F.col("keeps") & (F.col("text_hash") == F.col("first_hash"))
    gone = small(marked.where(~stays).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")), BROADCAST_IDS)
    hashed = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    same = lambda x: docs[key].cast("long").eqNullSafe(x["g_id"]) & (hashed == x["g_hash"])
    out = docs.join(gone, same(gone), "left_anti")
    again = stored(marked.where(stays & (F.col("n") > 1)).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")), "repeated")
    if not again.limit(1).count():
        return back(out)
    twice = out.join(again, same(again), "left_semi").dropDuplicates([key, text])
    return back(out.join(again, same(again), "left_anti").unionByName(twice))
