"""Katz backoff language model over words, of any order, counted and evaluated as Spark jobs.

Counts of every level are Good-Turing discounted; what a context loses by discounting
goes to its unseen successors in proportion to their probability one level down,
normalised exactly: for each context the probabilities of all words and of the unknown
word sum to 1. Words outside training share the mass that discounting leaves among the
words. With h for a context and h' for h without its first word:

    P(w | h) = d(c(h w)) c(h w) / c(h)   if the n-gram was seen
             = a(h) P(w | h')            otherwise;  a(h) = 1 for unseen h

The recursion is evaluated upwards, a level at a time: each n-gram of a text carries its
probability one level down to the table of its level, which gives back its own. A text
starts with as many start marks as the order asks for.

Data move as packed arrays, never one row for each token, and in hashed parts whose
size is set by the input:

1. documents fall into blocks of about ``BLOCK_BYTES``; each block counts its words
2. word parts add the counts up and give every word an id; blocks get back the ids
   of their own words only
3. blocks encode their documents. For each level from 2 to the order:
4. blocks count their n-grams; n-gram parts (by context, very frequent contexts by
   n-gram) add up the counts of training documents and are stored as the table of the
   level, with the places in it that each block asks for
5. each part computes its contexts' weights and answers every block; blocks take the
   answers to the next level, or sum them up document by document

Only count-of-count numbers and the contexts holding over 1 / (4 parts) of all
tokens (at most ``MAX_HOT``) pass the driver.

Defined results
- null and empty texts: the end token alone
- repeated rows are counted and scored like others; null doc_id is not held out
- no training document: every token has the one probability left, 1
- very long texts are whole; an empty table gives an empty result
- words are told apart by a 64-bit hash; ids are at most 2^31 (an error beyond);
  n-grams are compared by the ids of all their words
- an order below 2 is an error
- other columns are not read
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage

BLOCK_BYTES = 12_000_000
PART_BYTES = 10_000_000
MAX_HOT = 100_000
GT_MAX = 5  # counts up to this are discounted
START, END = 0, 1  # ids of the text's start (a context only) and of the end token
_MIX = np.uint64(0x9E3779B97F4A7C15)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount factors for counts 0..GT_MAX from n[r - 1], the number of types counted r times.

    The largest k whose factors all lie in (0, 1) is used; without one, 0.5 is taken off each count.
    """
    for k in range(GT_MAX, 0, -1):
        if min(n[: k + 1]) > 0:
            tail = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail) if tail < 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d, *[1.0] * (GT_MAX - k)])
    return np.array([1.0, *[(r - 0.5) / r for r in range(1, GT_MAX + 1)]])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= GT_MAX, d[np.minimum(counts, GT_MAX)], 1.0)


class Words:
    """Discounted word probabilities, and the whole unseen mass for the unknown word."""

    def __init__(self, total: int, hist: list[int], left: float, d: np.ndarray) -> None:
        self.total, self.d, self.unknown = total, d, left

    @classmethod
    def of(cls, total: int, hist: list[int]) -> Words:
        if not total:
            return cls(0, hist, 1.0, np.ones(GT_MAX + 1))
        d = discounts(hist)
        left = sum(r * hist[r - 1] * (1 - d[r]) for r in range(1, GT_MAX + 1)) / total
        if left <= 0:  # nothing rare enough to discount: one more token, unseen
            return cls(total + 1, hist, 1 / (total + 1), np.ones(GT_MAX + 1))
        return cls(total, hist, left, d)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / max(1, self.total), self.unknown)


def weights(n: np.ndarray, mass: np.ndarray, psum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, a) of contexts counted n, with discounted mass and word probability of their seen successors."""
    used, rest = mass / n, 1 - psum
    scale = np.ones(len(n))
    tight = (used > 1 - 1e-9) & (rest > 1e-12)  # nothing was discounted: make room for the unseen
    scale[tight] = n[tight] / (n[tight] + 1)
    whole = rest <= 1e-12  # every word was seen here
    scale[whole] = 1 / used[whole]
    left = np.maximum(0.0, 1 - used * scale)
    return scale, np.where(whole, 0.0, left / np.where(whole, 1, rest))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of equal key, as tables."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and k[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(k[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """8-byte values (sorted ones as steps), bytes of equal weight together, compressed."""
    v = np.diff(values, prepend=values.dtype.type(0)) if delta else values
    planes = np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8).T)
    return (len(v) << 1 | delta).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True) if len(v) else b"")


def unpack(data: bytes, dtype: type = np.int64) -> np.ndarray:
    head = int.from_bytes(data[:8], "little")
    n, delta = head >> 1, head & 1
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=8 * n, asbytes=True), np.uint8).reshape(8, n)
    v = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(v) if delta else v


def pack_few(x: np.ndarray) -> list[bytes]:
    """Floats that repeat: the distinct ones, and which of them each is."""
    values, which = np.unique(x, return_inverse=True)
    return [pack(values), pack(which)]


def unpack_few(data: list[bytes]) -> np.ndarray:
    return unpack(data[0], np.float64)[unpack(data[1])]


def _all(t: pa.Table, name: str) -> list[np.ndarray]:
    return [unpack(x) for x in t.column(name).to_pylist() if x is not None]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _binaries(parts: list[list[bytes]]) -> pa.Array:
    return pa.array(parts, pa.list_(pa.binary()))


def _split(of: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys in ``of`` and the places of each, in order."""
    order = np.argsort(of, kind="stable")
    keys, first = np.unique(of[order], return_index=True)
    return keys, np.split(order, first[1:]) if len(keys) else []


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _word_places(hashes: np.ndarray, word_parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The word parts of a block's sorted hashes, and the places of each: the order in which ids come back."""
    return _split((hashes % np.uint64(word_parts)).astype(np.int32))


def _block_words(word_parts: int):
    """word_part, block, hashes, counts: each block's words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _groups(batches, "block"):
            counts: Counter = Counter()
            other: set[bytes] = set()
            for train, text in zip(t.column("train"), t.column("text")):
                (counts if train.as_py() else other).update(words_of(text.as_py()))
            words = [*counts, *(other - counts.keys())]
            n = np.zeros(len(words), np.int64)
            n[: len(counts)] = np.fromiter(counts.values(), np.int64, len(counts))
            h, inverse = np.unique(_hashes(words), return_inverse=True)
            n = np.bincount(inverse, weights=n, minlength=len(h)).astype(np.int64)
            keys, places = _word_places(h, word_parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array(np.full(len(keys), block, np.int32)), _binary([pack(h[at]) for at in places]), _binary([pack(n[at]) for at in places])],
                names=["word_part", "block", "hashes", "counts"])

    return run


def _word_ids(word_parts: int):
    """block, word_part, ids, totals, in the order of the block's hashes; block -1 has hist: a part's types, tokens and counts of counts.

    Frequent words get small ids, which pack better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _groups(batches, "word_part"):
            hashes = _all(t, "hashes")
            h, n = _joined(hashes), _joined(_all(t, "counts"))
            known, inverse = np.unique(h, return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(known)).astype(np.int64)
            ids = np.empty(len(known), np.int64)
            ids[np.argsort(-total, kind="stable")] = 2 + part + np.arange(len(known)) * word_parts
            if ids.max(initial=0) >= 1 << 31:
                raise OverflowError("more than 2^31 word ids")
            keys, places = _split(np.repeat(t.column("block").to_numpy(), [len(x) for x in hashes]))
            hist = [int((total > 0).sum()), int(total.sum()), *[int((total == r).sum()) for r in range(1, GT_MAX + 2)]]
            yield pa.RecordBatch.from_arrays([
                pa.array([*keys.tolist(), -1], pa.int32()), pa.array([part] * (len(keys) + 1), pa.int32()), _binary([*[pack(ids[inverse[at]]) for at in places], None]),
                _binary([*[pack(total[inverse[at]]) for at in places], None]), pa.array([*[None] * len(keys), hist], pa.list_(pa.int64()))], names=["block", "word_part", "ids", "totals", "hist"])

    return run


Rows = list[np.ndarray]  # n-grams as columns of two word ids each, first words first; the last word of an odd number alone


def _grams(codes: Rows, k: int) -> Rows:
    """The k-grams that end at each token of the documents, one document after the other."""
    if not codes:
        return [np.empty(0, np.int64)] * -(-k // 2)
    flat = np.concatenate([x for c in codes for x in (np.full(k - 2, START), c)])
    begin = np.cumsum([0, *[len(c) + k - 2 for c in codes[:-1]]])
    token = np.ones(len(flat), bool)
    for i in range(k - 1):
        token[begin + i] = False
    first = np.flatnonzero(token) - (k - 1)
    return [flat[first + i] << 32 | flat[first + i + 1] if i + 1 < k else flat[first + i] for i in range(0, k, 2)]


def _context(grams: Rows, k: int) -> Rows:
    return grams[:-1] if k % 2 else [*grams[:-1], grams[-1] >> 32]


def _changes(rows: Rows) -> np.ndarray:
    """True where a row of sorted ones differs from the row before."""
    new = np.ones(len(rows[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
    return new


def _distinct(rows: Rows) -> tuple[Rows, np.ndarray]:
    """The distinct rows in order, and the place of each row among them."""
    if len(rows) == 1:
        known, inverse = np.unique(rows[0], return_inverse=True)
        return [known], inverse
    order = np.lexsort(rows[::-1])
    ordered = [c[order] for c in rows]
    new = _changes(ordered)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return [c[new] for c in ordered], inverse


def _mixed(rows: Rows) -> np.ndarray:
    h = np.zeros(len(rows[0]), np.uint64)
    for c in rows:
        h = (h ^ c.view(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def _part_of(grams: Rows, k: int, hot: np.ndarray, parts: int) -> np.ndarray:
    """By context; by the whole n-gram for contexts whose hash is in ``hot``."""
    h = _mixed(_context(grams, k))
    return (np.where(_among(h, hot), _mixed(grams), h) * _MIX >> np.uint64(33)).astype(np.int64) % parts


def _often(least: float):
    """h: hashes of the words or n-grams counted more than ``least`` times that can be a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grams, counts in zip(b.column("grams").to_pylist(), b.column("counts").to_pylist()):
                rows = [unpack(c) for c in grams]
                keep = (unpack(counts) > least) & (rows[-1] & 0xFFFFFFFF != END)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_mixed([c[keep] for c in rows])).view(np.int64))], names=["h"])

    return run


def _asked(block: int, codes: Rows, held: np.ndarray, lower: np.ndarray, k: int, hot: np.ndarray, parts: int) -> list[pa.Array]:
    """A block's k-grams by part: part, block, grams, counts in training, and probability one level down (given for each token)."""
    grams, inverse = _distinct(_grams(codes, k))
    counts = np.bincount(inverse[np.repeat(~held, [len(c) - 1 for c in codes])], minlength=len(grams[0])).astype(np.int64)
    low = np.empty(len(counts))
    low[inverse] = lower
    keys, places = _split(_part_of(grams, k, hot, parts))
    return [
        pa.array(keys, pa.int32()), pa.array(np.full(len(keys), block, np.int32)), _binaries([[pack(c[at], not i) for i, c in enumerate(grams)] for at in places]),
        _binary([pack(counts[at]) for at in places]), _binaries([pack_few(low[at]) for at in places])]


def _encode(total: int, types: int, n_train: int, unigram: Words, hot: np.ndarray, parts: int, word_parts: int):
    """Documents as word ids (out 0), and each block's bigrams by part (out 1)."""
    names = ["out", "block", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids", "part", "grams", "counts", "lower"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _groups(batches, "block"):
            docs = t.filter(pa.compute.equal(t.column("kind"), 1))
            distinct: set[bytes] = set()
            for text in docs.column("text"):
                distinct.update(words_of(text.as_py()))
            words = list(distinct)
            hashes = _hashes(words)
            h = np.unique(hashes)
            at_word = dict(zip(words, np.searchsorted(h, hashes).tolist()))
            told = t.filter(pa.compute.equal(t.column("kind"), 0))
            told = {p: (unpack(x), unpack(y)) for p, x, y in zip(told.column("word_part").to_pylist(), told.column("ids").to_pylist(), told.column("totals").to_pylist())}
            ids, totals = np.empty((2, len(h)), np.int64)
            for part, at in zip(*_word_places(h, word_parts)):
                ids[at], totals[at] = told[int(part)]
            log, p = np.log10((totals + 1) / (total + types + 1)), unigram.p(totals)
            end_log, end_known, end_p = math.log10((n_train + 1) / (total + types + 1)), int(n_train > 0), unigram.p(np.array([n_train]))
            del distinct, words, hashes, t
            coded, base, known, lower = [], [], [], []
            for text in docs.column("text"):
                words = words_of(text.as_py())
                at = np.fromiter(map(at_word.__getitem__, words), np.int64, len(words))
                base.append(float(log[at].sum()) + end_log)
                known.append(int((totals[at] > 0).sum()) + end_known)
                coded.append(np.r_[START, ids[at], END])
                lower += [p[at], end_p]
            if not coded:
                continue
            n = len(coded)
            null = lambda kind, m: pa.nulls(m, kind)
            binaries = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block, np.int32)), docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(),
                pa.array([len(c) - 1 for c in coded], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), _binary([pack(c) for c in coded]),
                null(pa.int32(), n), null(binaries, n), null(pa.binary(), n), null(binaries, n)], names=names)
            held = docs.column("held_out").to_numpy()
            part, of, *asked = _asked(block, coded, held, np.concatenate(lower), 2, hot, parts)
            m = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(m, np.int32)), of, null(docs.schema.field("doc_id").type, m), null(pa.bool_(), m), null(pa.int64(), m), null(pa.int64(), m),
                null(pa.float64(), m), null(pa.binary(), m), part, *asked], names=names)

    return run


def _told(codes: Rows, t: pa.Table, k: int, hot: np.ndarray, parts: int) -> np.ndarray:
    """The probability of each token at level k, from the answers (kind 0) to the block."""
    grams, inverse = _distinct(_grams(codes, k))
    places = dict(zip(*_split(_part_of(grams, k, hot, parts))))
    p = np.ones(len(grams[0]))
    answers = t.filter(pa.compute.equal(t.column("kind"), 0))
    for part, told in zip(answers.column("part").to_pylist(), answers.column("told").to_pylist()):
        p[places[part]] = unpack_few(told)
    return p[inverse]


def _next_level(k: int, hot_before: np.ndarray, hot: np.ndarray, parts: int):
    """Each block's k-grams by part, from its documents and the answers of the level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _groups(batches, "block"):
            docs = t.filter(pa.compute.equal(t.column("kind"), 1))
            codes = _all(docs, "ids")
            if codes:
                lower = _told(codes, t, k - 1, hot_before, parts)
                yield pa.RecordBatch.from_arrays(_asked(block, codes, docs.column("held_out").to_numpy(), lower, k, hot, parts), names=["part", "block", "grams", "counts", "lower"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of a level, one row a part: n-grams (those only asked for have count 0), and their places in what each block asked."""
    for part, t in _groups(batches, "part"):
        told = [[unpack(c) for c in g] for g in t.column("grams").to_pylist()]
        grams, inverse = _distinct([np.concatenate(c) for c in zip(*told)])
        total = np.bincount(inverse, weights=_joined(_all(t, "counts")), minlength=len(grams[0])).astype(np.int64)
        low = np.empty(len(total))
        low[inverse] = np.concatenate([unpack_few(x) for x in t.column("lower").to_pylist()])
        hist = [int((total == r).sum()) for r in range(1, GT_MAX + 2)]
        ends = np.cumsum([len(g[0]) for g in told])[:-1]
        asked = [{"block": b, "places": pack(at, True)} for b, at in zip(t.column("block").to_pylist(), np.split(inverse, ends))]
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), _binaries([[pack(c, not i) for i, c in enumerate(grams)]]), _binary([pack(total)]), _binaries([pack_few(low)]), pa.array([hist], pa.list_(pa.int64())),
            pa.array([asked], pa.list_(pa.struct([("block", pa.int32()), ("places", pa.binary())])))], names=["part", "grams", "counts", "lower", "hist", "asked"])


class _Contexts:
    """The contexts of a part's sorted n-grams: count, discounted mass and lower probability of the seen successors."""

    def __init__(self, grams: Rows, counts: np.ndarray, lower: np.ndarray, k: int, d: np.ndarray) -> None:
        context = _context(grams, k)
        new = _changes(context)
        first, self.of = np.flatnonzero(new), np.cumsum(new) - 1
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0)
        self.rows = [c[first] for c in context]
        self.n, self.mass, self.psum = add(counts.astype(np.float64)), add(discounted(counts, d)), add(np.where(counts > 0, lower, 0.0))


def _hot_sums(k: int, hot: np.ndarray, d: np.ndarray):
    """context, n, mass, psum: a part's share of the contexts whose n-grams are spread over all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grams, counts, lower in zip(*(b.column(c).to_pylist() for c in ("grams", "counts", "lower"))):
                c = _Contexts([unpack(g) for g in grams], unpack(counts), unpack_few(lower), k, d)
                keep = _among(_mixed(c.rows), hot) & (c.n > 0)
                rows = np.stack([r[keep] for r in c.rows], axis=1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(c.n[keep]), pa.array(c.mass[keep]), pa.array(c.psum[keep])], names=["context", "n", "mass", "psum"])

    return run


def _answer(k: int, d: np.ndarray, hot: np.ndarray, sums: dict[tuple[int, ...], tuple[float, float, float]]):
    """block, part, told: the probabilities of the block's n-grams in that part, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, grams, counts, lower, asked in zip(*(b.column(c).to_pylist() for c in ("part", "grams", "counts", "lower", "asked"))):
                counts, lower = unpack(counts), unpack_few(lower)
                c = _Contexts([unpack(g) for g in grams], counts, lower, k, d)
                for i in np.flatnonzero(_among(_mixed(c.rows), hot)).tolist():
                    c.n[i], c.mass[i], c.psum[i] = sums.get(tuple(int(r[i]) for r in c.rows), (0.0, 0.0, 0.0))
                scale, a = np.ones((2, len(c.n)))
                seen = c.n > 0
                scale[seen], a[seen] = weights(c.n[seen], c.mass[seen], c.psum[seen])
                p = np.where(counts > 0, (scale / np.where(seen, c.n, 1))[c.of] * discounted(counts, d), a[c.of] * lower)
                for x in asked:
                    yield pa.RecordBatch.from_arrays([pa.array([x["block"]], pa.int32()), pa.array([part], pa.int32()), _binaries([pack_few(p[unpack(x["places"])])])], names=["block", "part", "told"])

    return run


def _score(order: int, total: int, hot: np.ndarray, parts: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches, "block"):
            docs = t.filter(pa.compute.equal(t.column("kind"), 1))
            codes = _all(docs, "ids")
            if not codes:
                continue
            logs = np.log10(_told(codes, t, order, hot, parts))
            first = np.cumsum([0, *[len(c) - 1 for c in codes[:-1]]])
            cols = {c: docs.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            cols |= {"train_tokens": pa.array(np.full(len(codes), total)), "score": pa.array(np.add.reduceat(logs, first))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return run


def _dealt(df: DataFrame, key: str, *then: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *then)


GRAMS = "part int, block int, grams array<binary>, counts binary, lower array<binary>"
TABLE = "part int, grams array<binary>, counts binary, lower array<binary>, hist array<long>, asked array<struct<block:int,places:binary>>"


def score(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    The model learns from the rows where ``held_out`` is false.
    """
    if order < 2:
        raise ValueError("the order of the model is at least 2")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("n_train"), F.count("*").alias("n")).first()
    total_bytes, n_train = size["bytes"] or 0, size["n_train"]
    blocks, parts = -(-total_bytes // BLOCK_BYTES) or 1, -(-total_bytes // PART_BYTES) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    counted = _dealt(placed.select("block", (~F.col("held_out")).alias("train"), "text"), "block").mapInArrow(_block_words(parts), "word_part int, block int, hashes binary, counts binary")
    words = storage.materialize(_dealt(counted, "word_part").mapInArrow(_word_ids(parts), "block int, word_part int, ids binary, totals binary, hist array<long>"), "words")
    sums = _sums(words.where("block = -1")) or [0] * (GT_MAX + 3)
    types, total, hist = sums[0] + (n_train > 0), sums[1] + n_train, sums[2:]
    if 0 < n_train <= GT_MAX + 1:
        hist[n_train - 1] += 1  # the end token is a type as well
    unigram = Words.of(total, hist)
    often = total / min(4 * parts, MAX_HOT)
    hot = _hot(words.where("block >= 0").select(F.array("ids").alias("grams"), F.col("totals").alias("counts")), often, 2, n_train)

    told = words.where("block >= 0").select("block", F.lit(0).alias("kind"), "word_part", "ids", "totals")
    both = told.unionByName(placed.select("block", F.lit(1).alias("kind"), "doc_id", "held_out", "text"), allowMissingColumns=True)
    schema = f"out int, block int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, ids binary, part int, grams array<binary>, counts binary, lower array<binary>"
    encoded = storage.materialize(_dealt(both, "block", "kind").mapInArrow(_encode(total, types, n_train, unigram, hot, parts, parts), schema), "encoded", "out")
    storage.drop(words)
    coded = encoded.select("block", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids")
    if size["n"]:
        coded = spark.read.schema(coded.schema).parquet(f"{encoded.tidemark_path}/out=0")
    coded = coded.withColumn("kind", F.lit(1))

    grams = encoded.where("out = 1").select("part", "block", "grams", "counts", "lower")
    for k in range(2, order + 1):
        table = storage.materialize(_dealt(grams, "part").mapInArrow(_merge, TABLE), f"grams{k}")
        if k == 2:
            storage.delete(spark, f"{encoded.tidemark_path}/out=1")
        else:
            storage.drop(before)
        d = discounts(_sums(table) or [0] * (GT_MAX + 1))
        found = table.select("grams", "counts", "lower").mapInArrow(_hot_sums(k, hot, d), "context array<long>, n double, mass double, psum double").groupBy("context").agg(*[F.sum(c).alias(c) for c in ("n", "mass", "psum")]).collect()
        answers = table.select("part", "grams", "counts", "lower", "asked").mapInArrow(_answer(k, d, hot, {tuple(r[0]): (r[1], r[2], r[3]) for r in found}), "block int, part int, told array<binary>")
        joined = _dealt(answers.withColumn("kind", F.lit(0)).unionByName(coded, allowMissingColumns=True), "block", "kind")
        if k < order:
            hot_before, hot, before = hot, _hot(table.select("grams", "counts"), often, k + 1, n_train), table
            grams = joined.mapInArrow(_next_level(k + 1, hot_before, hot, parts), GRAMS)
    return joined.mapInArrow(_score(order, total, hot, parts), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _hot(grams: DataFrame, often: float, k: int, n_train: int) -> np.ndarray:
    """Sorted hashes of the contexts of level k counted more than ``often`` times."""
    found = [r["h"] for r in grams.mapInArrow(_often(often), "h long").distinct().collect()]
    start = _mixed(_context(_grams([np.array([START, END])], k), k)) if n_train > often else np.empty(0, np.uint64)
    return np.unique(np.r_[np.array(found, np.int64).view(np.uint64), start])


def _sums(rows: DataFrame) -> list[int]:
    """The position-wise sums of the arrays in ``hist``."""
    return [r["s"] for r in rows.select(F.posexplode("hist").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).orderBy("i").collect()]
