"""Grouping of spelling variants through a trie of letter-group counts.

Words are arranged in a trie whose levels are counts: first of a few large groups of
letters, then of single letters, then of letters within the first few places. One
inserted, deleted or replaced code point adds at most one letter to the counts (a
surplus) and takes at most one away (a deficit), so a depth-first search follows, at each
level, the equal count, the next higher or the next lower, as long as a budget of one
surplus and one deficit lasts; each family of levels has its own budget. Words in the
leaves reached are verified letter by letter.

The trie is dealt over tasks: its first levels are a key, and every word is sent to its
own node and, as a query, to the later ones of the nodes within the budget (at most ten):
a pair of words meets once and counts for both. Nodes of more than ``NODE`` words grow by
further levels until they are small, some levels in each join on the node; tasks search
what lies below. The driver sees counts only.

Defined results
- null texts hold no words; a null id counts as the empty text for ``change``
- repeated rows count each time; very long texts and runs are taken whole
- near words of equal count: the smallest in code-point order is taken
- an empty table gives an empty result; other columns are not read
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import is_not

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage

BETWEEN = "[^A-Za-zÀ-ÿ]+"  # what stands between letter runs
LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = 512  # whose words are counted together
NODE = 2_000  # words of a node that one task searches
STEP = 2  # levels by which large nodes grow at once
LEAF = 16  # words below a node that are compared without further levels
QUERIES = 16_384  # searched together
CELLS = 1 << 20  # pairs compared at once in a leaf
ENDS = 24  # letters compared from each end of a word before all are

#: Large groups of about equal weight in European text; any other letter belongs to the last.
GROUPS = ("eq", "aklx", "inz", "otbwj")
#: Letters with a level of their own, frequent ones first; other letters share levels by code point.
SINGLES = "rsdtulnoaicmpvghfbwykzjxqe"
SHARED = 6
PLACES = (4, 8, 2)  # levels for the letters in so many first places, for nodes that all letters leave large
MOST = 100  # higher counts are told as this one: differences only shrink, so nothing near is missed


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The large group and the single level of each code point below 256."""
    large, single = np.full(256, len(GROUPS)), np.full(256, 0)
    for g, letters in enumerate(GROUPS):
        large[[ord(c) for c in letters]] = g
    for c in range(256):
        single[c] = SINGLES.index(chr(c)) if chr(c) in SINGLES else len(SINGLES) + c % SHARED
    return large, single


LARGE, SINGLE = _classes()
FIRST = len(GROUPS) + 1  # levels of the key
LETTERS = len(SINGLES) + SHARED
#: The first level of each family and the end of the last: a family has its own budget.
FAMILIES = (0, FIRST, FIRST + LETTERS, *(FIRST + LETTERS + FIRST * (i + 1) for i in range(len(PLACES))))
LEVELS = FAMILIES[-1]


def counts(words: list[str]) -> np.ndarray:
    """Each word's count at every level of the trie."""
    codes = np.frombuffer("".join(words).encode("latin-1", "replace"), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    base = np.repeat(np.arange(len(words)) * LEVELS, sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    large = LARGE[codes]
    cells = [base + large, base + FAMILIES[1] + SINGLE[codes], *((base + FAMILIES[2 + i] + large)[place < p] for i, p in enumerate(PLACES))]
    found = np.bincount(np.concatenate(cells), minlength=len(words) * LEVELS)
    return np.minimum(found, MOST).astype(np.int8).reshape(len(words), LEVELS)


#: A key packs the counts of its levels, eight bits each; these steps lead to the keys within the budget.
UNIT = 1 << 8 * np.arange(FIRST, dtype=np.int64)[::-1]
STEPS = [(up, down) for up in (None, *range(FIRST)) for down in (None, *range(FIRST)) if up != down]


def ends(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last ``size`` letters of each word, from its ends inwards."""
    short = "".join(w[:size].ljust(size, "\0") + w[: -size - 1 : -1].ljust(size, "\0") for w in words)
    both = np.frombuffer(short.encode("latin-1", "replace"), np.uint8).reshape(len(words), 2, size)
    return both[:, 0], both[:, 1]


def one_edit(a: str, b: str) -> bool:
    """Whether one code point inserted, deleted or replaced makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _lower(run: str) -> str:
    return run if run.islower() else run.translate(LOWER)


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", change: Callable[[list[str], list[str]], list[str]] | None = None, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: lower-cased (A-Z only) letter runs of all texts with how often they occur.

    ``change(ids as text, runs)`` may replace runs before they are counted; it sees each
    run of a document once. Words shorter than ``min_chars`` or rarer than ``min_count``
    are left out. Tasks count within ``TEXTS`` texts and combine before the shuffle.
    """

    def counted(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        runs = pc.split_pattern_regex(texts.fill_null(""), BETWEEN)
        doc, run = pc.list_parent_indices(runs).to_numpy(), runs.flatten().dictionary_encode()
        lower = pa.array([*map(_lower, run.dictionary.to_pylist())], pa.string()).dictionary_encode()
        names = lower.dictionary.to_pylist()
        code = lower.indices.to_numpy()[run.indices.to_numpy()].astype(np.int64)
        total, moved = np.bincount(code, minlength=len(names)), []
        if change:
            pair, n = np.unique(doc.astype(np.int64) * len(names) + code, return_counts=True)
            of, real = pair % len(names), np.array([*map(bool, names)])
            pair, n, of = pair[real[of]], n[real[of]], of[real[of]]  # a text's ends may leave empty runs
            at, words = ids.fill_null("").to_pylist(), [*map(names.__getitem__, of.tolist())]
            made = change([*map(at.__getitem__, (pair // len(names)).tolist())], words)
            other = np.flatnonzero(np.fromiter(map(is_not, words, made), bool, len(words)))
            moved = [(made[i], int(n[i])) for i in other.tolist()]
            np.subtract.at(total, of[other], n[other])
        kept = np.flatnonzero((total > 0) & (np.fromiter(map(len, names), np.int64, len(names)) >= min_chars))
        more = [(m, many) for m, many in moved if len(m) >= min_chars]
        word = pa.concat_arrays([lower.dictionary.take(pa.array(kept)), pa.array([m for m, _ in more], pa.string())])
        return pa.RecordBatch.from_arrays([word, pa.array(np.concatenate([total[kept], np.array([k for _, k in more], np.int64)]))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                yield counted(b.column(0).slice(at, TEXTS), b.column(1).slice(at, TEXTS))

    source = storage.spread(docs).select(storage.col(id_col).cast("string").alias("id"), storage.col(text_col).alias("text"))
    parts = source.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


NODES = "key long, path string, member boolean, word string, n long, surplus byte, deficit byte"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n and the key of the word's node."""
    for b in batches:
        own = counts(b.column(0).to_pylist())[:, :FIRST].astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own @ UNIT)], names=["word", "n", "key"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word as a member of its node and as a query there and at the later nodes that it may reach."""
    for b in batches:
        word, n, key = b.columns
        key = key.to_numpy()
        yield _nodes(key, None, True, word, n)
        yield _nodes(key, None, False, word, n)
        for up, down in STEPS:
            step = (UNIT[up] if up is not None else 0) - (UNIT[down] if down is not None else 0)
            if step > 0:
                can = np.flatnonzero((key // UNIT[down]) % 256 > 0) if down is not None else np.arange(len(key))
                at = pa.array(can)
                yield _nodes(key[can] + step, None, False, word.take(at), n.take(at))


def _nodes(key: np.ndarray, path: list[str] | None, member, word: pa.Array, n: pa.Array, surplus: np.ndarray | None = None, deficit: np.ndarray | None = None) -> pa.RecordBatch:
    size, none = len(key), np.zeros(len(key), np.int8)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(path if path is not None else [""] * size, pa.string()), pa.array(np.broadcast_to(member, size)), word, n, pa.array(none if surplus is None else surplus, pa.int8()), pa.array(none if deficit is None else deficit, pa.int8())],
        names=[f.split()[0] for f in NODES.split(", ")])


def _grown(level: int):
    """Rows of large nodes, one level down: a query at the three children that its budget allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, path, member, word, n, surplus, deficit = b.columns
            key, path, member, up, down = key.to_numpy(), path.to_pylist(), member.to_numpy(zero_copy_only=False), surplus.to_numpy(), deficit.to_numpy()
            own = counts(word.to_pylist())[:, level]
            if level in FAMILIES:
                up, down = np.zeros_like(up), np.zeros_like(down)
            for more in (0, 1, -1):
                can = np.flatnonzero(np.full(len(key), True) if not more else ~member & ((up == 0) & (own < MOST) if more > 0 else (down == 0) & (own > 0)))
                at = pa.array(can)
                told = [f"{path[i]}{own[i] + more}," for i in can.tolist()]
                yield _nodes(key[can], told, member[can], word.take(at), n.take(at), up[can] + np.int8(more > 0), down[can] + np.int8(more < 0))

    return run


class Trie:
    """The words below one node, sorted by their counts: a node is a range of rows."""

    def __init__(self, words: list[str]) -> None:
        table = counts(words)
        self.order = np.lexsort(table.T[::-1])
        self.words = [words[i] for i in self.order]
        self.counts = table[self.order]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(words))
        self.ends = ends(self.words, ENDS)

    def search(self, queries: list[str], level: int, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (queries, words) of near pairs, found within the budgets from ``level`` on and verified."""
        asked, sizes, tips = counts(queries), np.fromiter(map(len, queries), np.int64, len(queries)), ends(queries, ENDS)
        for at, low, high, level, up, down in self._below(0, len(self.order), level, asked, np.arange(len(queries)), surplus, deficit):
            step = max(1, CELLS // (high - low))
            for first in range(0, len(at), step):
                part = slice(first, first + step)
                q, w = self._leaf(low, high, level, asked, at[part], up[part], down[part], tips)
                q, w = self._verified(q, w, queries, sizes, tips)
                if len(q):
                    yield q, self.order[w]

    def _below(self, low: int, high: int, level: int, asked: np.ndarray, at: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple]:
        """Leaves reached depth first below rows [low, high) of equal counts up to ``level``, with the queries that reach them."""
        while level < LEVELS and high - low > LEAF:
            if level in FAMILIES:
                surplus, deficit = np.zeros_like(surplus), np.zeros_like(deficit)
            column, own = self.counts[low:high, level], asked[at, level]
            if column[0] != column[-1]:
                cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
                for begin, end in zip(cuts[:-1], cuts[1:]):
                    some = self._within(column[begin], own, at, surplus, deficit)
                    if len(some[0]):
                        yield from self._below(low + begin, low + end, level + 1, asked, *some)
                return
            at, surplus, deficit = self._within(column[0], own, at, surplus, deficit)
            if not len(at):
                return
            level += 1
        yield at, low, high, level, surplus, deficit

    @staticmethod
    def _within(count: np.int8, own: np.ndarray, at: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries whose budget lasts for a child of this count, with what they have spent."""
        more = count - own
        up, down = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
        left = np.flatnonzero((up <= 1) & (down <= 1))
        return at[left], up[left], down[left]

    def _leaf(self, low: int, high: int, level: int, asked: np.ndarray, at: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, tips: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) whose remaining counts keep the budgets; one edit leaves the letters at one end of a word alone."""
        alike = np.zeros((len(at), high - low), bool)
        for mine, theirs in zip(tips, self.ends):
            alike |= (mine[at, None, 0] == theirs[None, low:high, 0]) & (mine[at, None, 1] == theirs[None, low:high, 1])
        short = self.sizes[low:high] < 5  # with fewer letters an edit may touch both ends
        q, w = np.nonzero(alike | short)
        for begin, end in zip(FAMILIES, FAMILIES[1:]):
            if end > level and len(q):
                more = self.counts[low + w, max(level, begin) : end] - asked[at[q], max(level, begin) : end]
                up, down = np.maximum(more, 0).sum(1, dtype=np.int16), np.maximum(-more, 0).sum(1, dtype=np.int16)
                if begin < level:
                    up, down = up + surplus[q], down + deficit[q]
                fits = (up <= 1) & (down <= 1)
                q, w = q[fits], w[fits]
        return at[q], low + w

    def _verified(self, q: np.ndarray, w: np.ndarray, queries: list[str], sizes: np.ndarray, tips: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are one edit apart: their common ends, then letter by letter."""
        if not len(q):
            return q, w
        common = []
        for mine, theirs in zip(tips, self.ends):
            differ = mine[q] != theirs[w]
            common.append(np.where(differ.any(1), differ.argmax(1), ENDS))
        longer = np.maximum(sizes[q], self.sizes[w])
        open_ = (common[0] == ENDS) | (common[1] == ENDS) | (longer > ENDS)
        might = np.flatnonzero((np.abs(sizes[q] - self.sizes[w]) <= 1) & (open_ | (common[0] + common[1] >= longer - 1)))
        near = [i for i in might.tolist() if one_edit(queries[q[i]], self.words[w[i]])]
        return q[near], w[near]


FOUND = "word string, n_near long, best long, form string"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, members first: of each word the near words found, counted, with the most frequent one."""
    node, rows = None, []

    def found() -> Iterator[pa.RecordBatch]:
        (key, path), b = node, pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        member = b.column("member").to_numpy(zero_copy_only=False)
        words, n = b.column("word").to_pylist(), b.column("n").to_numpy()
        m = int(member.sum())
        if not m or m == len(words):
            return
        level = FIRST + path.count(",")
        trie, pairs = Trie(words[:m]), []
        surplus, deficit = b.column("surplus").to_numpy(), b.column("deficit").to_numpy()
        both = counts(words)[:, :FIRST].astype(np.int64) @ UNIT != key  # words of one key ask for each other, others only one way
        for k in range(m, len(words), QUERIES):
            asked = slice(k, k + QUERIES)
            for q, w in trie.search(words[asked], level, surplus[asked], deficit[asked]):
                pairs += [(q + k, w), (w[both[q + k]], q[both[q + k]] + k)]
        if not pairs:
            return
        rank = np.empty(len(words), np.int64)
        rank[pc.array_sort_indices(b.column("word")).to_numpy()] = np.arange(len(words))  # UTF-8 sorts like code points
        word, near = (np.concatenate(x) for x in zip(*pairs))
        order = np.lexsort((rank[near], -n[near], word))
        word, near = word[order], near[order]
        own, first, many = np.unique(word, return_index=True, return_counts=True)
        best, names = near[first], b.column("word")
        yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(many), pa.array(n[best]), names.take(pa.array(best))], names=["word", "n_near", "best", "form"])

    for b in batches:
        key, path = b.column("key").to_numpy(), b.column("path")
        same = (key[1:] == key[:-1]) & pc.equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), b.num_rows] if b.num_rows else []
        for begin, end in zip(cuts[:-1], cuts[1:]):
            at = (int(key[begin]), path[begin].as_py())
            if at != node:
                if rows:
                    yield from found()
                node, rows = at, []
            rows.append(b.slice(begin, end - begin))
    if rows:
        yield from found()


def near_words(words: DataFrame, most: int = NODE) -> DataFrame:
    """word, n_near, best (largest count among the near words), form of each of ``words`` (word, n) that has near words."""
    keyed = storage.materialize(words.select("word", "n").mapInArrow(_keyed, "word string, n long, key long"), "variant-keys")
    rows = keyed.mapInArrow(_placed, NODES)
    sizes = keyed.select("key", F.lit("").alias("path")).groupBy("key", "path").agg(F.count("*").alias("members"))
    done: list[DataFrame] = []
    level = FIRST
    while True:
        nodes = storage.materialize(sizes, "variant-nodes")
        large = nodes.where(F.col("members") > most)
        if level >= LEVELS or large.isEmpty():
            done.append(rows)  # small nodes, or no level is left: a task searches them as they are
            break
        done.append(rows.join(large, ["key", "path"], "left_anti"))
        rows = rows.join(large, ["key", "path"], "left_semi")
        further = min(level + STEP, LEVELS)
        for k in range(level, further):
            rows = rows.select(*[f.split()[0] for f in NODES.split(", ")]).mapInArrow(_grown(k), NODES)
        rows, level = storage.materialize(rows, "variant-grown"), further
        sizes = rows.where("member").groupBy("key", "path").agg(F.count("*").alias("members"))
    dealt = reduce(DataFrame.unionByName, done).repartition("key", "path").sortWithinPartitions("key", "path", F.desc("member"))
    parts = dealt.select(*[f.split()[0] for f in NODES.split(", ")]).mapInArrow(_searched, FOUND)
    best = F.struct((-F.col("best")).alias("rank"), "form")
    told = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    return told.select("word", "n_near", (-F.col("b.rank")).alias("best"), F.col("b.form").alias("form"))


def group(words: DataFrame, factor: int = 2, most: int = NODE) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n, each word once).

    A word's form is its near word of largest count, if that is at least ``factor`` (2 or
    more) times its own; its root is the end of the chain of forms. Counts at least double
    along a chain, so pointers are doubled a few times: each round joins every word's
    present goal to that goal's own.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or chains of forms may not end")
    words = storage.materialize(words.select("word", "n"), "variant-words")
    near = near_words(words, most)
    strong = F.col("best") >= factor * F.col("n")
    formed = storage.materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("best")).alias("form_n")), "variant-forms")
    goals = formed.where("form is not null").select("word", F.col("form").alias("goal"))
    goals = storage.materialize(goals, "variant-goals")
    while True:
        on = goals.select(F.col("word").alias("goal"), F.col("goal").alias("further"))
        joined = storage.materialize(goals.join(on, "goal", "left"), "variant-goals")
        goals = joined.select("word", F.coalesce("further", "goal").alias("goal"))
        if joined.where("further is not null").isEmpty():
            break
    roots = goals.select("word", F.col("goal").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
