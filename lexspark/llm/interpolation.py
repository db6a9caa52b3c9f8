"""Language-model scoring by deleted interpolation.

Tokens are words (ASCII lower-cased, cut at ASCII white space) and one end for
each text.  A token's probability after its predecessor is

    l2 * c(v, w) / c(v)  +  l1 * c(w) / N  +  l0 * (c(w) + 0.1) / (N + 0.1 * S)

where the weights l depend on the bucket of the context's frequency, the number
of binary digits of c(v).  They are learned by expectation-maximisation: a tenth
of the training texts is deleted from the counts and its n-grams, as counted,
are the held-out counts.  Scores then use the counts of all training texts.

Every word is counted as itself, as a token, in pairs and as a context.  The TABLE
commonest are symbols of a broadcast table of bounded size, which is only a
short cut: pairs of them are exact 40-bit numbers, which tasks sort and send as
packed blocks, dealt by a hash of both words, so that a shuffled occurrence takes
a few bytes and a pair's occurrences within a batch of texts are one run.  A pair
with any other word (a tail word) is dealt by the hash of that word, to where the
exact counts of the tail words go by the same hash.  A tail word is rarer than
the whole table, so that its pairs are a small share.

A model of a limited vocabulary is made only on demand (``head``): words beyond
that many share one symbol of the n-grams, and a word's own probability within
the symbol is added from its exact count (plus 0.1).

Null and empty texts are one end token.  A null id counts as empty text in the
fold's checksum.  Repeated rows are counted, and scored, each.  Texts are taken
in batches of BATCH bytes and one text more at most, so that a very long one
stands alone.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

FOLDS = 10
HELD_OUT = 0
#: The training fold whose counts are deleted while the weights are learned.
DELETED = 1
HEAD = 1 << 18
BITS = 20
#: Words of the broadcast table: as many as symbols of BITS can tell apart.
TABLE = (1 << BITS) - 3
ALPHA = 0.1
ROUNDS = 40
#: Steps of a doubling in which held-out n-grams of like probability are pooled.
POOL = 8
NONE = -(1 << 20)
#: Bytes of texts whose pairs are sorted at a time.
BATCH = 8 << 20
#: Occurrences for one task, about.
SHARE = 2_000_000
#: Token hashes that a task counts at a time.
COUNTED = 4_000_000
#: A random number for each byte at each of 64 places in a word.
_PLACES = np.random.Generator(np.random.PCG64(20_000)).integers(0, 1 << 64, 64 * 256, np.uint64)
_FAR = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint16)
_SPACE = np.array([b in b"\x20\t\n\x0b\x0c\r" for b in range(256)])


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, ends apart, and how many each text has: sums of random numbers for each byte and place."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    black = ~_SPACE[raw]
    inner = off[(off > 0) & (off < len(raw))]
    start = black.copy()
    start[1:] &= ~black[:-1]
    start[inner] = black[inner]
    stop = black.copy()
    stop[:-1] &= ~black[1:]
    stop[inner - 1] = black[inner - 1]
    begin = np.flatnonzero(start)
    size = np.flatnonzero(stop) - begin + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    value = _PLACES[((place & 63) << 8) | _LOWER[raw[black]]]
    if size.max() > 64:
        late = np.flatnonzero(place > 63)
        power = np.cumprod(np.full(int(place.max()) // 64 + 1, _FAR))
        value[late] *= power[place[late] // 64]
    return np.add.reduceat(value, first), np.diff(np.searchsorted(begin, off))


def _input(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(name, t).alias("key"), (F.crc32(name.cast("binary")) % FOLDS).cast("int").alias("fold"), t.alias("text"))


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """About BATCH bytes of rows at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        if (size := size + part.nbytes) >= BATCH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on as planes of bytes, as many as the largest number needs."""
    out = [np.array([len(columns), len(columns[0])], np.uint64).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c, np.int64).view(np.uint64)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        out += [bytes([width]), c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    (columns, n), at, out = np.frombuffer(data, np.uint64, 2).tolist(), 16, []
    for _ in range(columns):
        width = data[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
        out.append(wide.view(np.int64).ravel())
        at += 1 + width * n
    return out


def _blocks(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(part, its columns) of rows, in their order."""
    if len(part) and part.max() < 1 << 16:
        part = part.astype(np.uint16)  # is sorted by its digits
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(edge, [*edge[1:], len(part)]):
        yield int(part[a]), [c[a:b] for c in columns]


def _sorted_with(pair: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each with its tag; tags are small numbers from 0 on: both fit one number, which sorts fast."""
    bits = max(1, int(tag.max()).bit_length()) if len(tag) else 1
    if bits + 2 * BITS > 63:
        order = np.argsort(pair, kind="stable")
        return pair[order], tag[order]
    both = np.sort((pair << bits) | tag)
    return both >> bits, both & ((1 << bits) - 1)


def _rows(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names = dict(x.split() for x in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names.items()], list(names))


def _unigrams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, list[np.ndarray]] = {True: [], False: []}

    def out() -> Iterator[pa.RecordBatch]:
        for kept, lists in held.items():
            if lists:
                word, c = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c), pa.array(c * kept)], ["word", "c", "r"])
                lists.clear()

    for part in parts:
        token, sizes = hashed(part.column("text"))
        fold = np.repeat(part.column("fold").to_numpy(), sizes)
        held[False].append(token[fold == DELETED])
        held[True].append(token[(fold != DELETED) & (fold != HELD_OUT)])
        if sum(len(x) for lists in held.values() for x in lists) > COUNTED:
            yield from out()
    yield from out()


class Symbols:
    """The head words' hashes (ascending) with their counts in all and in the kept training texts, then the shared symbol, end and start."""

    def __init__(self, word: np.ndarray, c: np.ndarray, r: np.ndarray, total: dict, merged: bool, cut: int):
        self.merged, self.cut = merged, cut
        order = np.argsort(word.view(np.uint64))
        self.word, self.size, self.total = word.view(np.uint64)[order], len(word), total
        self.rare, self.end, self.start = self.size, self.size + 1, self.size + 2
        self.c = np.concatenate([c[order], [total["c"] - c.sum(), total["docs"], total["docs"]]]).astype(np.float64)
        self.r = np.concatenate([r[order], [total["r"] - r.sum(), total["kept_docs"], total["kept_docs"]]]).astype(np.float64)

    def _slots(self) -> np.ndarray:
        """Open addressing by the hashes' low bits, a quarter full at most; -1 is free."""
        if not hasattr(self, "slots"):
            mask = (4 << max(1, self.size).bit_length()) - 1
            slots, todo, at = np.full(mask + 1, -1, np.int32), np.arange(self.size, dtype=np.int32), (self.word & np.uint64(mask)).astype(np.int64)
            while len(todo):
                free = slots[at] < 0
                slots[at[free]] = todo[free]
                lost = slots[at] != todo
                todo, at = todo[lost], (at[lost] + 1) & mask
            self.slots = slots
        return self.slots

    def find(self, token: np.ndarray) -> np.ndarray:
        """Symbols of hashed words."""
        slots = self._slots()
        mask = len(slots) - 1
        out = np.full(len(token), self.rare, np.int64)
        todo, at = np.arange(len(token)), (token & np.uint64(mask)).astype(np.int64)
        while len(todo):
            k = slots[at]
            same = (k >= 0) & (self.word[np.maximum(k, 0)] == token[todo]) if self.size else np.zeros(len(k), bool)
            out[todo[same]] = k[same]
            on = np.flatnonzero((k >= 0) & ~same)
            todo, at = todo[on], (at[on] + 1) & mask
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of all texts, their ends included: symbols of those before, and their own; sizes of the texts; and hashes of rare words."""
        token, sizes = hashed(texts)
        sizes = sizes + 1
        inner = self.find(token)
        end = np.cumsum(sizes) - 1
        word = np.ones(len(token) + len(sizes), bool)
        word[end] = False
        second = np.full(len(word), self.end, np.int64)
        second[word] = inner
        first = np.append(self.start, second[:-1])
        first[end[:-1] + 1] = self.start
        return first, second, sizes, token[inner == self.rare].view(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}

    def parts(self, kept: bool, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bucket of the context and the three estimates, for pairs of symbols with their counts."""
        count = self.r if kept else self.c
        return self.estimates(kept, count[pair >> BITS], count[pair & ((1 << BITS) - 1)], n)

    def estimates(self, kept: bool, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the counts of the context, the token and the pair."""
        total = (self.r if kept else self.c)[: self.size + 2].sum()
        kinds = (self.size if self.merged else self.total["v"]) + 2
        bucket = np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) + 1, 0)
        return bucket, n / np.maximum(v, 1), w / max(total, 1), (w + ALPHA) / (total + ALPHA * kinds)


def symbols(counts: DataFrame, docs: int, kept_docs: int, head: int, merged: bool) -> Symbols:
    bins = {r.bin: r.n for r in counts.groupBy(F.floor(8 * F.log2("c")).alias("bin")).agg(F.count("*").alias("n")).collect()}
    cut, room = max(bins, default=0) + 1, head
    for b in sorted(bins, reverse=True):
        if bins[b] > room:
            break
        cut, room = b, room - bins[b]
    total = counts.agg(F.sum("c").alias("c"), F.sum("r").alias("r"), F.count("*").alias("v")).first()
    top = counts.where(F.floor(8 * F.log2("c")) >= cut).toArrow()
    col = lambda k: top.column(k).to_numpy()
    return Symbols(col("word"), col("c"), col("r"), {"c": total.c or 0, "r": total.r or 0, "v": total.v, "docs": docs, "kept_docs": kept_docs}, merged, cut)


def _part_of(hashed: np.ndarray, parts_n: int) -> np.ndarray:
    return ((hashed.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts_n


#: Kinds of blocks, and bits of tails.
PAIRS, TAILS, WORDS = 0, 1, 2
V_TAIL, W_TAIL = 1, 2
BLOCK = "part int, kind int, data binary"


def _counted(shared, parts_n: int):
    """Blocks of the pairs of symbols of the training texts, counted by kept and deleted texts; and of every pair with a tail word.

    The columns of the latter: the words, as hashes if they are of the tail, else as symbols; 4 times the fold's kind (0
    held out, 1 deleted, 2 kept) and the bits of tails; the text's key.  They are dealt by the token if it is of the tail.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Symbols = shared.value
        for whole in _batches(parts):
            first, second, sizes, far = s.ids(whole.column("text"))
            fold = whole.column("fold").to_numpy()
            kind = np.repeat(np.where(fold == HELD_OUT, 0, np.where(fold == DELETED, 1, 2)), sizes)
            rows = []
            v_tail, w_tail = first == s.rare, second == s.rare
            tail = np.flatnonzero((v_tail | w_tail) & (not s.merged))
            if len(tail):
                v, w = first.copy(), second.copy()
                w[w_tail] = far
                v[np.flatnonzero(w_tail) + 1] = far  # an end follows every text's last word
                key = np.repeat(whole.column("key").to_numpy(), sizes)[tail]
                flag = kind[tail] * 4 + v_tail[tail] * V_TAIL + w_tail[tail] * W_TAIL
                v, w = v[tail], w[tail]
                for to, x in _blocks(_part_of(np.where(flag & W_TAIL, w, v), parts_n), v, w, flag, key):
                    rows.append({"part": to, "kind": TAILS, "data": packed(*x)})
            on = kind > 0 if s.merged else (kind > 0) & ~v_tail & ~w_tail
            # One sort of packed numbers: pair, then whether the text is kept.
            pair = np.sort((((first[on] << BITS) | second[on]) << 1) | (kind[on] == 2))
            if len(pair):
                kept, pair = pair & 1, pair >> 1
                new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                r, n = np.add.reduceat(kept, new), np.diff(np.append(new, len(pair)))
                for to, (x, a, b) in _blocks(_part_of(pair[new], parts_n), pair[new], r, n - r):
                    rows.append({"part": to, "kind": PAIRS, "data": packed(np.diff(x, prepend=0), a, b)})
            yield _rows(BLOCK, rows)

    return run


def _words(parts_n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            word, c, r = (part.column(k).to_numpy() for k in ("word", "c", "r"))
            yield _rows(BLOCK, [{"part": to, "kind": WORDS, "data": packed(*x)} for to, x in _blocks(_part_of(word, parts_n), word, c, r)])

    return run


#: What a part's pairs come to: cells of held-out counts, or occurrences of pairs with a tail word, with the pair's
#: counts and those of its tail words (0 if they are in no training text), but for the context of two tail words.
LEARNT = "bucket long, q2 long, q1 long, held long, v long, w long, tails int, kind int, key long, n long, pr long, vc long, vr long, wc long, wr long"


def _gathered(parts: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[list[np.ndarray]]]]:
    """The blocks of each part, by kind."""
    out: dict[int, dict[int, list]] = {}
    for part in parts:
        for to, kind, data in zip(*(part.column(k).to_pylist() for k in ("part", "kind", "data"))):
            out.setdefault(to, {PAIRS: [], TAILS: [], WORDS: []})[kind].append(unpacked(data))
    return out


def _together(blocks: list[list[np.ndarray]], columns: int) -> list[np.ndarray]:
    return [np.concatenate([*(x[k] for x in blocks), np.zeros(0, np.int64)]) for k in range(columns)]


def _learnt(shared):
    names = [x.split()[0] for x in LEARNT.split(", ")]

    def rows(length: int, **columns: np.ndarray) -> pa.RecordBatch:
        kind = lambda c: pa.int32() if c in ("tails", "kind") else pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(np.int64), kind(c)) if c in columns else pa.nulls(length, kind(c)) for c in names], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Symbols = shared.value
        for blocks in _gathered(parts).values():
            pair, r, d = _together([[np.cumsum(x), a, b] for x, a, b in blocks[PAIRS]], 3)
            if len(pair):
                pair, order = _sorted_with(pair, np.arange(len(pair)))
                r, d = r[order], d[order]
                new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                pair, r, d = pair[new], np.add.reduceat(r, new), np.add.reduceat(d, new)
                pair, r, d = pair[d > 0], r[d > 0], d[d > 0]
            if len(pair):
                x = _cells(*s.parts(True, pair, r), d)
                yield rows(len(x), bucket=x["bucket"], q2=x["q2"], q1=x["q1"], held=x["n"])
            v, w, flag, key = _together(blocks[TAILS], 4)
            if not len(v):
                continue
            word, c, r = _together(blocks[WORDS], 3)
            order = np.argsort(word)
            word, c, r = np.append(word[order], 0), np.append(c[order], 0), np.append(r[order], 0)
            tails, kind = flag & 3, flag >> 2
            by_w = tails != V_TAIL
            tail = np.where(by_w, w, v)
            at = np.searchsorted(word[:-1], tail)
            hit = (word[at] == tail) & (at < len(word) - 1)
            c, r = np.where(hit, c[at], 0), np.where(hit, r[at], 0)
            order = np.lexsort((tails, v, w))
            same = np.ones(len(v), bool)
            same[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1]) | (tails[order][1:] != tails[order][:-1])
            group = np.empty(len(v), np.int64)
            group[order] = np.cumsum(same) - 1
            n, pr = np.bincount(group, kind >= 1)[group], np.bincount(group, kind >= 2)[group]
            yield rows(len(v), v=v, w=w, tails=tails, kind=kind, key=key, n=n, pr=pr, vc=np.where(by_w, 0, c), vr=np.where(by_w, 0, r), wc=np.where(by_w, c, 0), wr=np.where(by_w, r, 0))

    return run


def _tails(learnt: DataFrame, low: DataFrame) -> DataFrame:
    """The occurrences of pairs with tail words; contexts of two tail words get their counts by a join."""
    t = learnt.where("tails is not null").drop("bucket", "q2", "q1", "held")
    both = F.col("tails") == V_TAIL + W_TAIL
    two = t.where(both).drop("vc", "vr").join(low.select(F.col("word").alias("v"), F.col("c").alias("vc"), F.col("r").alias("vr")), "v", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    t = t.where(~both).unionByName(two).select("tails", "kind", "key", "n", "pr", *map(zero, ("vc", "vr", "wc", "wr")), "v", "w")
    # Symbols stay for a look into the table; hashes have done their work.
    mine = lambda c, bit: F.when(F.col("tails").bitwiseAND(F.lit(bit)) == 0, F.col(c)).otherwise(0).alias(c)
    return t.select("tails", "kind", "key", "n", "pr", "vc", "vr", "wc", "wr", mine("v", V_TAIL), mine("w", W_TAIL))


def _cells(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    step = lambda p: np.where(p > 0, np.round(POOL * np.log2(np.maximum(p, 1e-300) / p0)), NONE).astype(np.int64)
    cell, at = np.unique(np.stack([bucket, step(p2), step(p1)]), axis=1, return_inverse=True)
    return pd.DataFrame({"bucket": cell[0], "q2": cell[1], "q1": cell[2], "n": np.bincount(at.ravel(), d).astype(np.int64)})


def learned(cells: list[tuple[int, int, int, int]], buckets: int = 64) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket by EM on pooled held-out counts (bucket, q2, q1, n); a bucket without any takes those of all."""
    x = np.array(cells, np.int64).reshape(-1, 4)
    out = np.tile([0.0, 0.5, 0.5], (buckets, 1))

    def em(rows: np.ndarray) -> np.ndarray:
        ratio = np.stack([np.where(rows[:, k] > NONE, 2.0 ** (rows[:, k] / POOL), 0.0) for k in (1, 2)] + [np.ones(len(rows))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            part = ratio * w
            w = (part / part.sum(axis=1, keepdims=True) * rows[:, 3:4]).sum(axis=0) / rows[:, 3].sum()
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    if len(x):
        out[:] = em(x)
        for b in np.unique(x[:, 0]):
            out[b] = em(x[x[:, 0] == b])
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]  # an unseen context says nothing
    return out


#: A block of pairs with the texts that they are in, a text, or the sums of a batch's texts over a part's pairs.
SCAN = "part int, data binary, batch long, at int, doc_id long, key long, held_out boolean, n_tokens long, known long, base double, rare array<long>"


def _batch_part(batch: int, parts_n: int) -> int:
    return int(_part_of(np.array([batch], np.int64), parts_n)[0])


def _scanned(shared, parts_n: int):
    """For each part, sorted pairs with the texts of the batch that they are in; and a row for each text.

    A text's row has its known tokens and base score so far, and in a merged model the hashes of its rare words.  A batch
    is known by its task and place, which are the same whenever the task runs again.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Symbols = shared.value
        n, v = s.total["c"] + s.total["docs"], s.total["v"] + (s.total["docs"] > 0)
        base = np.log10((s.c + ALPHA) / (n + ALPHA * (v + 1)))
        base[s.rare] = 0.0
        for k, whole in enumerate(_batches(parts)):
            batch = TaskContext.get().partitionId() << 32 | k
            first, second, sizes, far = s.ids(whole.column("text"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            score = np.bincount(doc, base[second], len(sizes))
            is_rare = second == s.rare
            n_rare = np.bincount(doc[is_rare], minlength=len(sizes))
            known = sizes - n_rare - (s.total["docs"] == 0)
            fold = whole.column("fold").to_numpy()
            train = (fold != HELD_OUT).astype(np.int64)
            mine = {"part": pa.array(np.full(len(sizes), _batch_part(batch, parts_n), np.int32)), "data": pa.nulls(len(sizes), pa.binary()), "batch": pa.array(np.full(len(sizes), batch)), "at": pa.array(np.arange(len(sizes), dtype=np.int32))}
            mine |= {"doc_id": whole.column("doc_id").combine_chunks(), "key": whole.column("key").combine_chunks(), "held_out": pa.array(fold == HELD_OUT), "n_tokens": pa.array(sizes), "known": pa.array(known), "base": pa.array(score)}
            mine["rare"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)).astype(np.int32)), pa.array(far)) if s.merged else pa.nulls(len(sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(mine)
            on = np.ones(len(first), bool) if s.merged else (first != s.rare) & ~is_rare
            pair, doc = (first[on] << BITS) | second[on], doc[on]
            (pair, doc), rows = _sorted_with(pair, doc), []
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
            runs, order = np.diff(np.append(new, len(pair))), np.arange(len(new))
            for to, (x, m, k) in _blocks(_part_of(pair[new], parts_n), pair[new], runs, order):
                begin = np.cumsum(m) - m
                which = doc[np.repeat(new[k] - begin, m) + np.arange(int(m.sum()))]
                data = b"".join([len(a := packed(np.diff(x, prepend=0), m)).to_bytes(8, "little"), a, len(a := packed(which)).to_bytes(8, "little"), a, packed(train)])
                rows.append({"part": to, "data": data, "batch": batch})
            if rows:
                yield _rows(SCAN, rows)

    return run


def _texts_through(parts: Iterator[pa.RecordBatch], blocks: list) -> Iterator[pa.RecordBatch]:
    """The rows of texts pass, all others are put into blocks as (part, batch, data)."""
    for part in parts:
        is_text = part.column("data").is_null()
        if texts := is_text.true_count:
            yield part.filter(is_text)
        if texts < part.num_rows:
            rest = part.filter(is_text.to_numpy(zero_copy_only=False) == 0)
            blocks += zip(*(rest.column(k).to_pylist() for k in ("part", "batch", "data")))


def _scored(shared, weights: np.ndarray, parts_n: int):
    """Sums of log10 probabilities over the pairs of a part for the texts of each batch; the texts' rows pass through."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Symbols = shared.value
        held: list[tuple[int, int, bytes]] = []
        yield from _texts_through(parts, held)
        for of in sorted({x[0] for x in held}):
            mine = [x for x in held if x[0] == of]
            pairs, counts, docs = [], [], []
            for _, _, data in mine:
                cut = 8 + int.from_bytes(data[:8], "little")
                step, m = unpacked(data[8:cut])
                to = cut + 8 + int.from_bytes(data[cut : cut + 8], "little")
                (which,), (train,) = unpacked(data[cut + 8 : to]), unpacked(data[to:])
                pairs.append(np.cumsum(step))
                counts.append(np.add.reduceat(train[which], np.cumsum(m) - m))
                docs.append((m, which.astype(np.uint32), len(train)))
            sizes = np.array(list(map(len, pairs)))
            pair = np.concatenate(pairs)
            pair, order = _sorted_with(pair, np.arange(len(pair)))
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            bucket, p2, p1, p0 = s.parts(False, pair[new], np.add.reduceat(np.concatenate(counts)[order], new))
            w = weights[bucket]
            log = np.empty(len(pair))
            log[order] = np.repeat(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0), np.diff(np.append(new, len(pair))))
            del pair, order, pairs, counts
            rows = []
            for (_, batch, _), a, b, (m, which, n) in zip(mine, np.cumsum(sizes) - sizes, np.cumsum(sizes), docs):
                rows.append({"part": _batch_part(batch, parts_n), "batch": batch, "data": np.bincount(which, np.repeat(log[a:b], m), n).tobytes()})
            yield _rows(SCAN, rows)

    return run


TEXT = "doc_id long, key long, held_out boolean, n_tokens long, known long, base double, rare array<long>, s double"


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's row with its sum."""
    sums: dict[int, np.ndarray] = {}
    texts = []
    for part in parts:
        held: list[tuple[int, int, bytes]] = []
        texts += _texts_through(iter([part]), held)
        for _, batch, data in held:
            x = np.frombuffer(data)
            sums[batch] = sums[batch] + x if batch in sums else x
    for part in texts:
        batch, at = part.column("batch").to_pylist(), part.column("at").to_pylist()
        # a batch may have no pair in the table
        s = pa.array([float(sums[b][k]) if b in sums else 0.0 for b, k in zip(batch, at)], pa.float64())
        yield pa.RecordBatch.from_arrays([*(part.column(x.split()[0]) for x in TEXT.split(", ")[:-1]), s], [x.split()[0] for x in TEXT.split(", ")])


def _tail_estimates(s: Symbols, kept: bool, part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    tails, count = part["tails"].to_numpy(), s.r if kept else s.c
    own = lambda word, at, bit: np.where(tails & bit, part[at].to_numpy(), count[np.where(tails & bit, 0, part[word].to_numpy())])
    v, w = own("v", "vr" if kept else "vc", V_TAIL), own("w", "wr" if kept else "wc", W_TAIL)
    return s.estimates(kept, v.astype(np.float64), w.astype(np.float64), part["pr" if kept else "n"].to_numpy())


def _tail_pooled(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield _cells(*_tail_estimates(shared.value, True, part), np.ones(len(part)))

    return run


def _tail_scored(shared, weights: np.ndarray):
    """For each text of a batch, the known ones of its tail words, their base scores and the scores of all its tail pairs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s: Symbols = shared.value
        n, v = s.total["c"] + s.total["docs"], s.total["v"] + (s.total["docs"] > 0)
        for part in parts:
            if not len(part):
                continue
            bucket, p2, p1, p0 = _tail_estimates(s, False, part)
            w, c = weights[bucket], part["wc"].to_numpy()
            is_w = (part["tails"].to_numpy() & W_TAIL) > 0
            key, at = np.unique(part["key"].to_numpy(), return_inverse=True)
            sums = lambda x: np.bincount(at, x, len(key))
            yield pd.DataFrame({"key": key, "more_known": sums(is_w & (c > 0)), "more_base": sums(np.where(is_w, np.log10((c + ALPHA) / (n + ALPHA * (v + 1))), 0.0)), "more_score": sums(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0))})

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", head: int | None = None, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    head: at most so many words are kept apart (by default all are); table: words in the broadcast table, which changes no result.
    """
    merged = head is not None
    spark = docs.sparkSession
    bounded_batches(spark)
    d = _input(docs, text, key)
    counts = stored(d.mapInArrow(_unigrams, "word long, c long, r long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("r").alias("r")), "lm-words")
    by = {r.fold: r.n for r in d.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    train = sum(n for f, n in by.items() if f != HELD_OUT)
    s = symbols(counts, train, train - by.get(DELETED, 0), head if merged else min(table, TABLE), merged)
    shared = spark.sparkContext.broadcast(s)
    total = s.total["c"] + train
    parts_n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARE)
    low = counts.where(F.floor(8 * F.log2("c")) < s.cut)

    blocks = d.mapInArrow(_counted(shared, parts_n), BLOCK)
    if not merged:
        blocks = blocks.unionByName(low.mapInArrow(_words(parts_n), BLOCK))
    learnt = stored(blocks.repartitionById(parts_n, F.col("part")).mapInArrow(_learnt(shared), LEARNT), "lm-learnt")
    cells = learnt.where("tails is null").select("bucket", "q2", "q1", F.col("held").alias("n"))
    tails = None if merged else stored(_tails(learnt, low), "lm-tails")
    if tails is not None:
        cells = cells.unionByName(tails.where("kind = 1").mapInPandas(_tail_pooled(shared), "bucket long, q2 long, q1 long, n long"))
    weights = learned([tuple(r) for r in cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()])

    sums = d.mapInArrow(_scanned(shared, parts_n), SCAN).repartitionById(parts_n, F.col("part")).mapInArrow(_scored(shared, weights, parts_n), SCAN)
    texts = stored(sums.repartitionById(parts_n, F.col("part")).mapInArrow(_summed, TEXT), "lm-texts")

    more = ("more_known", "more_base", "more_score")
    if tails is None:
        # Rare words: exact counts by a join; absent ones have count 0.
        v, rare_n, rare_v = s.total["v"] + (train > 0), float(s.c[s.rare]), s.total["v"] - s.size
        rare = texts.select("key", F.explode("rare").alias("word")).join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        rare = rare.groupBy("key").agg(
            F.sum((F.col("c") > 0).cast("long")).alias("more_known"),
            F.sum(F.log10((F.col("c") + ALPHA) / (total + ALPHA * (v + 1)))).alias("more_base"),
            F.sum(F.log10((F.col("c") + ALPHA) / (rare_n + ALPHA * (rare_v + 1)))).alias("more_score"),
        )
    else:
        rare = tails.mapInPandas(_tail_scored(shared, weights), "key long, more_known double, more_base double, more_score double").groupBy("key").agg(*[F.sum(c).alias(c) for c in more])
    # Equal rows share a key: their rare words were counted once for each of them.
    copies = texts.where("rare is not null" if merged else "true").groupBy("key").agg(F.count("*").alias("copies"))
    per = stored(rare.join(copies, "key").select("key", *[(F.col(c) / F.col("copies")).alias(c) for c in more]), "lm-rare")
    both = texts.join(per, "key", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in more})
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.round("more_known").cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        (F.col("s") + F.col("more_score")).alias("score"),
    )
