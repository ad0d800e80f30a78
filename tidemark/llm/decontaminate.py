"""Benchmark decontamination by the q-gram lemma.

A stretch of text within ``k`` edits of an item of ``m`` characters shares at least
m - q + 1 - q*k of its q-grams, all on diagonals (text position minus item position)
that span k. Shared q-grams are counted in diagonal bands of width 2k + 2 or more that overlap
by k + 1, so some band holds all of them; bands that reach the bound are verified by
alignment restricted to the band's diagonals.

The lemma holds for any choice of the item's positions, since an edit spoils at most q
of them; positions whose q-gram an item repeats more than ``REPEATS`` times are left out
of the count, so repetitive texts give no more hits than others. Items that then have
too few positions (a line of dashes) are found by their q-grams in windows of m + k
characters instead, and verified over the stretches that reach the bound.

Texts and items are compared lower-cased, with white space runs as one blank. An item
longer than ``WINDOW`` characters is looked for as overlapping windows of that length, so
a quotation of one and a half windows of it is found; shorter items are found as a
whole. Each budget is ``RATE`` of the length, lowered where the lemma would demand fewer
than one q-gram. Texts are read in overlapping parts of ``PART`` characters or more.
Benchmarks up to ``CHUNK_CHARS`` characters go to the tasks as one table; longer ones are
split into several such tables, each with its own pass.

Defined results
- null and empty texts match nothing, null and empty items match nothing
- items under ``Q`` characters match as whole words, without edits
- repeated items, and items of equal text, each report; edits: of the best window
- repeated documents report alike; null doc_id is reported as null
- empty tables give an empty result; other columns are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage

Q = 8  # one machine word of folded characters
RATE = 0.1
WINDOW = 160
REPEATS = 4
PART = 1 << 16
CHUNK_CHARS = 4_000_000
FILTER_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """Every q-gram as one word of q folded characters; equal q-grams give equal words."""
    folded = chars if chars.dtype == np.uint8 else (chars ^ chars >> np.uint32(8)).astype(np.uint8)
    return np.ndarray((len(folded) - Q + 1,), "<u8", np.ascontiguousarray(folded), 0, (1,))


def _slot(words: np.ndarray) -> np.ndarray:
    return words * _MIX >> np.uint64(64 - FILTER_BITS)


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed to an item of m >= Q characters."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int]:
    """Fewest edits between ``item`` and any stretch of ``text`` on diagonals low..high, and the stretch's end.

    ``limit + 1`` if there is none within ``limit``.
    """
    whole = text.astype(np.uint32).tobytes()
    exact = whole.find(item.astype(np.uint32).tobytes())
    if exact >= 0 and exact % 4 == 0 and low <= exact // 4 <= high:
        return 0, exact // 4 + len(item)
    width, far = high - low + 1, limit + 1
    diagonal = np.arange(low, high + 1)
    row = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, far).astype(np.int64)  # a match may begin anywhere
    step = np.arange(width)
    for i, c in enumerate(item.tolist(), 1):
        j = diagonal + i  # text characters used
        inside = (j >= 0) & (j <= len(text))
        same = np.zeros(width, np.int64)
        at = (j >= 1) & (j <= len(text))
        same[at] = text[j[at] - 1] == c
        best = np.where(j >= 1, row + 1 - same, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)  # an item character left out
        best[~inside] = far
        row = np.minimum(np.minimum.accumulate(best - step) + step, far)  # text characters put in
        row[~inside] = far
        if row.min() > limit:
            return far, -1
    k = int(row.argmin())
    return int(row[k]), int(diagonal[k] + len(item))


def windows(chars: np.ndarray, size: int) -> list[np.ndarray]:
    """Windows of ``size`` characters, each half a window on, the last one at the end; a shorter text is one window."""
    starts = [*range(0, max(1, len(chars) - size), max(1, size // 2)), max(0, len(chars) - size)]
    return [chars[i : i + size] for i in dict.fromkeys(starts)]


class Index:
    """q-grams of the items' windows, with a bit filter before the exact search."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, window: int = WINDOW) -> None:
        self.ids, self.text, self.k, self.of, self.words = [i for i, _ in items], [], [], [], {}
        for n, (item_id, text) in enumerate(items):
            whole = normal(text)
            if 0 < len(whole) < Q:
                self.words.setdefault(whole.count(" ") + 1, {}).setdefault(whole, []).append(item_id)
            for chars in windows(codes(whole), window) if len(whole) >= Q else ():
                self.of.append(n)
                self.text.append(chars)
                self.k.append(budget(len(chars), rate))
        self.longest = max(map(len, self.text), default=0)
        # bands of width 2^shift overlap by half; half is more than k, so any k + 1 diagonals lie in one
        self.shift = np.array([max(2, int(2 * k + 1).bit_length()) for k in self.k], np.int64)
        self.least = np.zeros(len(self.text), np.int64)
        counted, loose = [], []
        for i, (t, k) in enumerate(zip(self.text, self.k)):
            g = grams(t)
            known, at, n = np.unique(g, return_inverse=True, return_counts=True)
            rare = np.flatnonzero(n[at] <= REPEATS)
            if len(rare) > Q * k:
                self.least[i] = len(rare) - Q * k
                counted.append((g[rare], np.full(len(rare), i), rare))
            else:
                loose.append((known, np.full(len(known), i), np.zeros(len(known), np.int64)))
        self.gram, self.item, self.pos = self._sorted(counted)
        self.loose_gram, self.loose_item, _ = self._sorted(loose)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[_slot(self.gram)] = True
        self.seen[_slot(self.loose_gram)] = True

    @staticmethod
    def _sorted(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        if not rows:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        g, item, pos = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(g, kind="stable")
        return g[order], item[order], pos[order]

    def _found(self, words: np.ndarray, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, entry) of the q-grams of the text in a sorted table."""
        if not len(gram):
            return at[:0], at[:0]
        first = np.searchsorted(gram, words)
        known = gram[np.minimum(first, len(gram) - 1)] == words
        at, first, words = at[known], first[known], words[known]
        n = np.searchsorted(gram, words, side="right") - first
        return np.repeat(at, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, edits, end in the normalised text) of the best match of each item found."""
        whole = normal(text)
        chars = codes(whole)
        best: dict[int, tuple[int, int]] = {}
        part = max(PART, 4 * self.longest)
        overlap = 2 * self.longest + 2
        for start in range(0, max(1, len(chars) - overlap), part - overlap) if self.text else ():
            self._match_part(chars[start : start + part], start, best)
        found: dict[int, tuple[int, int]] = {}
        for i, said in best.items():
            found[self.of[i]] = min(said, found.get(self.of[i], said))
        out = [(self.ids[n], *found[n]) for n in sorted(found)]
        if self.words:
            tokens = whole.split(" ") if whole else []
            for n, short in self.words.items():
                for phrase in {" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} & short.keys():
                    out += [(item_id, 0, (f" {whole} ").find(f" {phrase} ") + len(phrase)) for item_id in short[phrase]]
        return out

    def _match_part(self, chars: np.ndarray, start: int, best: dict[int, tuple[int, int]]) -> None:
        if len(chars) < Q:
            return
        words = grams(chars)
        at = np.flatnonzero(self.seen[_slot(words)])
        if not len(at):
            return
        words = words[at]
        for i, low, high in [*self._bands(words, at), *self._stretches(words, at)]:
            if best.get(i, (1,))[0] == 0:
                continue
            k = self.k[i]
            begin = max(0, low - k)
            region = chars[begin : high + k + len(self.text[i]) + 1]
            edits, end = banded_distance(self.text[i], region, low - k - begin, high + k - begin, k)
            if edits <= k and (i not in best or (edits, end + begin + start) < best[i]):
                best[i] = (edits, end + begin + start)

    def _bands(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, lowest, highest diagonal) of the bands that reach the bound."""
        t, entry = self._found(words, at, self.gram)
        item, pos = self.item[entry], self.pos[entry]
        plenty = np.bincount(item, minlength=len(self.text))[item] >= self.least[item]
        item, pos, diagonal = item[plenty], pos[plenty], (t - pos)[plenty]
        band = diagonal >> self.shift[item] - 1
        key = np.concatenate([item << 40 | band + (1 << 32), item << 40 | band - 1 + (1 << 32)])  # band b: halves b and b + 1
        known, n = np.unique(key, return_counts=True)
        known = known[n >= self.least[known >> 40]]
        if not len(known):
            return
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        full = known[place] == key
        each = np.unique(place[full] * self.longest + np.concatenate([pos, pos])[full])  # a q-gram of the item counts once
        for x in known[np.bincount(each // self.longest, minlength=len(known)) >= self.least[known >> 40]].tolist():
            i, b = x >> 40, (x & (1 << 40) - 1) - (1 << 32)
            low = b << int(self.shift[i] - 1)
            yield i, low, low + (1 << int(self.shift[i])) - 1

    def _stretches(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The same for windows of few different q-grams: diagonals of the stretches with enough of their q-grams."""
        t, entry = self._found(words, at, self.loose_gram)
        item = self.loose_item[entry]
        order = np.argsort(item, kind="stable")
        for i, places in zip(*_runs(item[order], t[order])):
            m, k = len(self.text[i]), self.k[i]
            need = m - Q + 1 - Q * k  # distinct text positions within m + k characters
            if len(places) < need:
                continue
            ends = places[need - 1 :]
            near = np.flatnonzero(ends - places[: len(ends)] < m + k)
            if not len(near):
                continue
            low, high = places[near] - m - k, places[near] + m + k
            cut = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(low)]):
                yield i, int(low[a]), int(high[a:b].max())


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct values of sorted ``keys`` and the ``values`` of each."""
    known, first = np.unique(keys, return_index=True)
    return known.tolist(), np.split(values, first[1:]) if len(known) else []


def _chunks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in pieces of about ``limit`` characters, one on the driver at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = -(-total // limit)
    for p in range(parts):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()]


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, item_id, edits: every benchmark item found in each whole document text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _chunks(benchmark, chunk_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by chunk_chars

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate)
            for b in batches:
                row, item, edits = [], [], []
                for k, t in enumerate(b.column(1)):
                    for i, e, _ in index.matches(t.as_py()):
                        row.append(k)
                        item.append(i)
                        edits.append(e)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "edits"])

        out = out.unionByName(storage.spread(docs).select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item; all other rows as they were."""
    for items in _chunks(benchmark, chunk_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by chunk_chars

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = storage.mapped(storage.spread(docs), run, docs.schema)
    return docs
