"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

The pieces that match a text span a lattice; a path's probability is the product
of its pieces' weights, normalised over all paths.  The vocabulary is the one
given; as it is a BPE model without probabilities, a piece weighs 1 / (rank + 1).
A character without a piece is spelt in byte pieces.  As in the library, a space
becomes U+2581, one is put in front, and pieces do not reach over a space.

Backward sums give each arc's probability given its start, so a path is a chain
of choices.  The top-down sampler is an A* search: a heap holds disjoint sets of
paths, each with the exact maximum of its members' Gumbel-perturbed log
probabilities; the best is popped, its maximal path is completed and emitted,
and what is left of the set splits at each choice of that path into new sets
whose maxima are Gumbels truncated at the popped one.  The paths come out
distinct and in order, as a sample without replacement.  The next bound on the
heap gives each its inclusion score, 1 - exp(-exp(log_prob - bound)), as a
logarithm; with no set left, every path is out and the score is 1.

A text is cut at spaces and, if no piece holds a line feed but at its start, at
these.  Its lattice is the chain of its tokens' lattices, and tokens repeat: each
worker keeps the lattices of those it met first, up to KEPT characters, and
builds the others for a batch.  Neither changes a result.  A batch holds BATCH
bytes, and one text more at most; a text without a space is one lattice, at
about 300 bytes a character while it is built.

All draws hash the row's key, the token, the step and the sample, so a row gives
the same samples anywhere.  Null and empty texts have one path, of no pieces.
Rows of equal key and text get equal samples.  A U+2581 in a text decodes as a
space, as in the library.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held

SAMPLES = 2
SPACE = "▁"
#: Characters of the tokens whose lattices a worker keeps.
KEPT = 600_000
#: Bytes of texts at a time.
BATCH = 1 << 19
OUT = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, decodes boolean"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Characters with a column of their own in the trie's table.
_DENSE = 128
#: What stands after a token in an array of code points.
_STOP = 0x110000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(*parts) -> np.ndarray:
    """Hashed integers."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = _mix((h ^ np.atleast_1d(np.asarray(p, np.int64)).view(np.uint64)) * _GOLD + _GOLD)
    return h


def _uniform(*parts) -> np.ndarray:
    """In (0, 1), from hashed integers."""
    return _unit(_seed(*parts))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Pieces:
    """The vocabulary: weights and bytes of pieces, and a trie of their characters."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.text: list[bytes] = []
        self.byte = np.zeros(256, np.int64)
        names: dict[str, int] = {}
        rank = 0
        logs = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            logs.append(0.0)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
                continue
            self.text.append(piece.replace(SPACE, " ").encode())
            logs[i] = -np.log(rank + 1.0)
            rank += 1
            names[piece] = i
        self.raw = np.array(self.text, object)
        self.log = np.array(logs)
        self.byte_log = -np.log(rank + 1.0)
        self.longest = max(map(len, names), default=0)
        self.lines = not any("\n" in x[1:] for x in names)
        # The trie: a node for each beginning of a piece; columns of the table are the commonest characters.
        node = {"": 0}
        for piece in names:
            for n in range(1, len(piece) + 1):
                node.setdefault(piece[:n], len(node))
        common = [c for c, _ in Counter("".join(names)).most_common(_DENSE - 1)]
        self.column = np.zeros(_STOP + 1, np.int32)
        for k, c in enumerate(common, 1):
            self.column[ord(c)] = k
        self.table = np.full(len(node) * _DENSE, -1, np.int32)
        self.piece = np.full(len(node), -1, np.int32)
        rest = {}
        for prefix, at in node.items():
            if prefix:
                up, c = node[prefix[:-1]], ord(prefix[-1])
                if k := int(self.column[c]):
                    self.table[up * _DENSE + k] = at
                else:
                    rest[up << 21 | c] = at
                self.piece[at] = names.get(prefix, -1)
        self.other = np.array(sorted(rest), np.int64)
        self.other_node = np.array([rest[x] for x in self.other.tolist()], np.int32)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, or -1."""
        column = self.column[code]
        out = self.table[node * _DENSE + column]
        if len(self.other) and len(low := np.flatnonzero(column == 0)):
            key = node[low].astype(np.int64) << 21 | code[low]
            at = np.minimum(np.searchsorted(self.other, key), len(self.other) - 1)
            out[low] = np.where(self.other[at] == key, self.other_node[at], -1)
        return out

    def spelt(self, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ident with characters without a piece, -1 - code point, replaced by byte pieces; and how many each gave."""
        n = np.ones(len(ident), np.int64)
        low = np.flatnonzero(ident < 0)
        if not len(low):
            return ident, n
        code, at = np.unique(ident[low], return_inverse=True)
        each = [self.byte[list(chr(-c - 1).encode("utf-8", "surrogatepass"))] for c in code.tolist()]
        n[low] = np.array([len(x) for x in each])[at]
        out = np.repeat(ident, n)
        out[out < 0] = np.concatenate([each[k] for k in at])
        return out, n

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


class Lattice:
    """Lattices of tokens: a state is a character's position, its arcs lie together, longer ones first."""

    def __init__(self, pieces: Pieces, kept: int = KEPT):
        self.pieces, self.kept = pieces, kept
        self.state: dict[str, int] = {}
        self.states = self.arcs = 0
        self.passing: list[str] = []
        self.lasting = (0, 0)
        self.first, self.log, self.cum = np.zeros(1 << 12, np.int64), np.zeros(1 << 14), np.zeros(1 << 14)
        self.next, self.ident = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def hold(self, tokens: set[str]) -> None:
        """From now on, state has the first states of these tokens."""
        if self.passing:
            for t in self.passing:
                del self.state[t]
            self.passing, (self.states, self.arcs) = [], self.lasting
        new = [t for t in tokens if t not in self.state]
        if new:
            self._add(new)
        if self.states <= self.kept:
            self.lasting = self.states, self.arcs
        else:
            self.passing = new

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = getattr(self, name)
        if at + len(values) > len(have):
            more = np.zeros(max(2 * len(have), at + len(values)) if len(have) < 1 << 22 else at + len(values) + (1 << 20), have.dtype)
            more[:at] = have[:at]
            setattr(self, name, have := more)
        have[at : at + len(values)] = values

    def _add(self, tokens: list[str]) -> None:
        p = self.pieces
        whole = [t if t[:1] == "\n" and p.lines else SPACE + t for t in tokens]
        size = np.array(list(map(len, whole)), np.int32) + 1  # with the stop
        begin = np.cumsum(size, dtype=np.int32) - size
        n = int(size.sum())
        inner = np.ones(n, bool)
        inner[begin + size - 1] = False
        code = np.full(n, _STOP, np.int32)
        code[inner] = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.int32)
        left = np.repeat(begin + size - 1, size) - np.arange(n, dtype=np.int32)
        at = np.flatnonzero(inner).astype(np.int32)
        node, found, one = np.zeros(len(at), np.int32), [], np.zeros(n, bool)
        for length in range(1, p.longest + 1):
            node = p.step(node, code[at + np.int32(length - 1)])
            on = np.flatnonzero(node >= 0)
            at, node = at[on], node[on]
            if not len(at):
                break
            ident = p.piece[node]
            on = np.flatnonzero(ident >= 0)
            found.append((at[on], length, ident[on]))
            if length == 1:
                one[found[0][0]] = True
        bare = np.flatnonzero(inner & ~one).astype(np.int32)
        found.append((bare, 1, -code[bare] - 1))  # spelt in bytes
        width = np.bincount(np.concatenate([x[0] for x in found]), minlength=n)
        first = np.append(0, np.cumsum(width))
        total = int(first[-1])
        place = first[1:].astype(np.int32)  # shorter arcs are filled in from the end
        end, ident = np.empty(total, np.int32), np.empty(total, np.int32)
        for start, length, which in [found[-1], *found[:-1]]:
            to = place[start] - np.int32(1)
            place[start] = to
            end[to] = start + np.int32(length)
            ident[to] = which
        del found, place, node, at
        log = p.log[np.maximum(ident, 0)]
        if len(bare):
            point = -ident[low := np.flatnonzero(ident < 0)] - 1
            log[low] = p.byte_log * (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        # Backward sums, over the states with the same distance to the end of their token.
        far = left.astype(np.uint16) if n and left.max() < 1 << 16 else left
        order = np.argsort(far, kind="stable")[len(tokens) :]
        cut = np.append(np.flatnonzero(np.append(True, left[order][1:] != left[order][:-1])), len(order))
        beta = np.zeros(n)
        for a, b in zip(cut[:-1], cut[1:]):
            s = order[a:b]
            w = width[s]
            seg = np.cumsum(w) - w
            which = np.repeat(first[s] - seg, w) + np.arange(int(w.sum()))
            v = log[which] + beta[end[which]]
            beta[s] = np.logaddexp.reduceat(v, seg)
            log[which] = v - np.repeat(beta[s], w)
        prob = np.exp(log)
        cum = prob.copy()
        some, k = np.flatnonzero(width > 1), 1
        while len(some):
            cum[first[some] + k] += cum[first[some] + k - 1]
            k += 1
            some = some[width[some] > k]
        cum[first[1:][width > 0] - 1] = 2.0  # the last arc takes what rounding leaves
        base = self.states
        self._put("first", base, first + self.arcs)
        self._put("log", self.arcs, log)
        self._put("cum", self.arcs, cum)
        self._put("next", self.arcs, np.where(code[end] == _STOP, -1, end + base).astype(np.int32))
        self._put("ident", self.arcs, ident.astype(np.int32))
        self.state.update(zip(tokens, (begin + base).tolist()))
        self.states, self.arcs = base + n, self.arcs + total

    def complete(self, key: np.ndarray, place: np.ndarray, state: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of sampled paths from each state to its token's end, in order, and how many each has."""
        count, steps = np.zeros(len(state), np.int64), []
        if not len(state):
            return np.zeros(0, np.int64), count
        act, now = np.arange(len(state)), state
        seed = _seed(key, place, sample)
        while len(act):
            u = _unit(_mix(seed[act] + np.uint64(len(steps) * int(_GOLD) & (2**64 - 1))))
            arc = self.first[now]
            on = np.flatnonzero(u >= self.cum[arc])
            while len(on):
                arc[on] += 1
                on = on[u[on] >= self.cum[arc[on]]]
            steps.append((act, arc))
            count[act] += 1
            go = self.next[arc]
            more = np.flatnonzero(go >= 0)
            act, now = act[more], go[more]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, arc) in enumerate(steps):
            out[begin[who] + k] = arc
        return out, count


def _words(text: str) -> list[str]:
    """Words of a line without their first U+2581: each begins with the spaces before it."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, spaces = [words[0]], ""
    if not words[0]:
        out, spaces = [], ""
    for word in words[len(out) :]:
        if word:
            out.append(spaces + word)
            spaces = ""
        else:
            spaces += SPACE
    return [*out, spaces[1:]] if spaces else out


def _split(text: str, lines: bool = False) -> list[str]:
    """Tokens of a text, without a first U+2581; with lines, those that begin with a line feed never had one."""
    if not text:
        return []
    if not lines or "\n" not in text:
        return _words(text)
    first, *rest = text.split("\n")
    out = _words(first) if first else [""]
    for line in rest:
        words = line.split(" ")
        words[0] = "\n" + words[0]
        if "" in words:
            words = [words[0], *_words(" ".join(words[1:]))] if len(words) > 1 else words
        out += words
    return out


def _after(log: np.ndarray, gone: float, start: float) -> np.ndarray:
    """log of the mass that leaves the path at each choice; gone: mass at the first choice already left."""
    before = np.empty(len(log))
    before[0] = start
    np.cumsum(log[:-1], out=before[1:])
    before[1:] += start
    rest = -np.expm1(log)
    rest[0] -= gone
    with np.errstate(divide="ignore", invalid="ignore"):
        return before + np.where(rest > 1e-12, np.log(rest), -np.inf)


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    return float(x) if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def paths(lat: Lattice, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (arcs, log_prob, perturbed, log_inclusion)."""
    split = [_split(x, lat.pieces.lines) for x in texts]
    lat.hold(set().union(*split))
    count = np.array([len(x) for x in split], np.int64)
    state = np.fromiter(map(lat.state.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(count.sum()))
    del split
    first_token = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(state)) - first_token[doc]
    arcs, width = lat.complete(keys[doc], place, state, np.zeros(len(state), np.int64))
    token = np.repeat(place, width)
    cut = np.append(0, np.cumsum(np.bincount(doc, width, len(texts)).astype(np.int64)))
    top = -np.log(-np.log(_uniform(keys, -1, 0, 0))) if len(keys) else keys
    out: list[list] = [[] for _ in texts]
    heaps: list[list] = [[] for _ in texts]

    def emit(d: int, path: np.ndarray, token: np.ndarray, g: float, at: int, gone: tuple, mass: float) -> None:
        """Puts out a path and splits the rest of its set, from choice at on, where the arcs gone with their mass are out already."""
        log = lat.log[path]
        out[d].append((path, float(log.sum()), float(g)))
        if at >= len(path):
            return
        phi = _after(log[at:], mass, float(log[:at].sum()))
        noise = -np.log(-np.log(_unit(_mix(noise_seed[d] + np.arange(at, len(path), dtype=np.uint64) * _GOLD))))
        bound = -np.logaddexp(-g, -(phi + noise))
        want = k + 1 - len(out[d])
        some = np.argpartition(-bound, want - 1)[:want] if len(bound) > want else np.arange(len(bound))
        for s in some.tolist():
            if phi[s] > -np.inf:
                left = (*gone, int(path[at])) if s == 0 else (int(path[at + s]),)
                heapq.heappush(heaps[d], (-float(bound[s]), len(out[d]), at + s, path, token, left))

    noise_seed = _seed(keys, 1, -7)
    for d in range(len(texts)):
        a, b = cut[d], cut[d + 1]
        emit(d, arcs[a:b], token[a:b], top[d], 0, (), 0.0)
    for sample in range(1, k):
        noise_seed, turn = _seed(keys, sample + 1, -7), _unit(_seed(keys, sample, -3))
        jobs = []
        t_place, t_state, owner = [], [], []
        for d in range(len(texts)):
            if not heaps[d] or len(out[d]) != sample:
                continue
            g, _, at, path, token, gone = heapq.heappop(heaps[d])
            a = int(np.searchsorted(lat.first[: lat.states + 1], path[at], side="right")) - 1  # the state of the choice
            choice = np.arange(lat.first[a], lat.first[a + 1])
            p = np.exp(lat.log[choice])
            p[np.array(gone) - choice[0]] = 0.0
            c = np.cumsum(p)
            arc = int(choice[min(int(np.searchsorted(c, turn[d] * c[-1], side="right")), int(np.flatnonzero(p)[-1]))])
            tok = int(token[at])
            rest = np.arange(tok + 1, count[d])
            st = state[first_token[d] + tok + 1 : first_token[d] + count[d]]
            if lat.next[arc] >= 0:
                rest, st = np.append(tok, rest), np.append(lat.next[arc], st)
            jobs.append((d, -g, at, path, token, gone, arc, tok))
            t_place.append(rest)
            t_state.append(st)
            owner.append(len(rest))
        if not jobs:
            break
        place2 = np.concatenate(t_place)
        owned = np.repeat(np.arange(len(jobs)), owner)
        arcs2, width2 = lat.complete(np.repeat(keys[[j[0] for j in jobs]], owner), place2, np.concatenate(t_state).astype(np.int64), np.full(len(place2), sample))
        token2 = np.repeat(place2, width2)
        edge = np.append(0, np.cumsum(np.bincount(owned, width2, len(jobs)).astype(np.int64)))
        for j, (d, g, at, path, token, gone, arc, tok) in enumerate(jobs):
            w = slice(edge[j], edge[j + 1])
            new = np.concatenate([path[:at], [arc], arcs2[w]])
            emit(d, new, np.concatenate([token[:at], [tok], token2[w]]), g, at, gone, float(np.exp(lat.log[list(gone)]).sum()))
    done = []
    for d in range(len(texts)):
        bound = -heaps[d][0][0] if heaps[d] else None
        done.append([(path, log, g, 0.0 if bound is None else _log_inclusion(log - bound)) for path, log, g in out[d]])
    return done


def sampled(pieces: Pieces, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log_prob, perturbed, log_inclusion)."""
    lat = Lattice(pieces)
    return [[(pieces.spelt(lat.ident[path].astype(np.int64))[0], *rest) for path, *rest in found] for found in paths(lat, texts, keys, k)]


def _lattice(model: bytes) -> Lattice:
    """The worker's lattices for a model."""
    return held(hashlib.sha256(model).digest(), lambda: Lattice(Pieces(model)))


def encoded(lat: Lattice, ids: pa.Array, texts: list[str], seeds: np.ndarray, samples: int) -> pa.RecordBatch:
    """The rows of OUT for a batch of texts."""
    pieces = lat.pieces
    found = paths(lat, texts, seeds, samples)
    rows = [(d, n, *x) for d, xs in enumerate(found) for n, x in enumerate(xs, 1)]
    size = np.array([len(r[2]) for r in rows], np.int64)
    flat, n = pieces.spelt(lat.ident[np.concatenate([*(r[2] for r in rows), np.zeros(0, np.int64)])].astype(np.int64))
    cut = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(size))]
    flat = flat.astype(np.int32)
    said, edge = pieces.raw[flat].tolist(), cut.tolist()
    plain = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    same = [b"".join(said[a:b]) == plain[r[0]] for r, a, b in zip(rows, edge, edge[1:])]
    col = lambda k, kind: pa.array([r[k] for r in rows], kind)
    return pa.RecordBatch.from_arrays(
        [ids.take(col(0, pa.int64())), col(1, pa.int32()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat)), pa.array(np.diff(cut).astype(np.int32)), col(3, pa.float64()), col(4, pa.float64()), col(5, pa.float64()), pa.array(same, pa.bool_())],
        [x.split()[0] for x in OUT.split(", ")],
    )


def encode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """Up to samples rows for each row of docs: sampled segmentations, the first being the most perturbed."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH)
    model = spark.sparkContext.broadcast(open(model_file, "rb").read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(model.value)
        for part in parts:
            if part.num_rows:
                yield encoded(lat, part.column("doc_id"), part.column("t").to_pylist(), part.column("seed").to_numpy(), samples)

    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.xxhash64(F.col(key).cast("string")).alias("seed"))
    return d.mapInArrow(run, OUT)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text of each row's ids; null ids give null."""
    bounded_batches(encoded.sparkSession, BATCH)
    model = encoded.sparkSession.sparkContext.broadcast(open(model_file, "rb").read())

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _lattice(model.value).pieces
        for part in parts:
            yield pd.Series([None if x is None else pieces.decode(x.tolist()) for x in part], dtype=object)

    return encoded.withColumn(out, texts(F.col(ids)))
