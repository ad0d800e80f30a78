"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training scores its log frequency in each language. An unseen word
is padded with markers and read position by position with the longest n-gram (4
down to 1) that any language knows; its score is the mean over positions, so an
unseen word weighs as one word. The language with the highest sum wins. The score of
a text is the winner's share when each language weighs exp(its mean over the words):
1 / languages for a text that fits all alike, near 1 for one that fits a single one,
whatever its length.

The model is fitted on a bounded sample of labelled documents (``DOCS_PER_LANG`` of
each language, by hash) and keeps every word and n-gram of it; its size is bounded by
that sample. Prediction reads whole texts.

Defined results
- null, empty or letterless text: ``und`` with score 0
- no labelled document at all: ``und`` with score 0 for every row
- equal sums: the language first in alphabetical order
- repeated rows are predicted alike, null doc_id included; very long texts whole
- an empty table gives an empty result; other columns are not read
- n-grams are of UTF-16 units, so a character beyond the basic plane counts as two
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import storage

DOCS_PER_LANG = 2000
SIZES = (4, 3, 2, 1)
CACHE = 200_000  # unseen words whose scores a task keeps, fewer with many languages:
CELLS = 8_000_000  # scores kept at most
SLICE = 500  # texts scored together
WORDS = 50_000  # words whose n-grams are counted together
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    found = LETTERS.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def _units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of all words, each between its markers, and the word of each unit."""
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    starts = np.cumsum([0, *[len(w.encode("utf-16-le", "surrogatepass")) // 2 + 2 for w in words]])
    return data, np.repeat(np.arange(len(words)), np.diff(starts))


def grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of the padded words as one machine word, 0 where it would leave its word, and the word of each."""
    data, of = _units(words)
    key = np.zeros(len(data), np.uint64)
    for i in range(n):
        key[: len(data) - i] |= data[i:] << np.uint64(16 * i)
    inside = np.zeros(len(data), bool)
    inside[: len(data) - n + 1] = of[: len(data) - n + 1] == of[n - 1 :]
    return np.where(inside, key, 0), of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            words, c = list(found), np.fromiter(found.values(), np.int64, len(found))
            yield batch(lang, 0, words, np.zeros(len(words), np.int64), c)
            for n, k in product(SIZES, range(0, len(words), WORDS)):
                key, of = grams(words[k : k + WORDS], n)
                known, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, weights=c[k : k + WORDS][of], minlength=len(known)).astype(np.int64)
                keep = known != 0
                yield batch(lang, n, [None] * int(keep.sum()), known[keep].view(np.int64), total[keep])
        counts.clear()

    def batch(lang: str, n: int, words: list, keys: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(np.full(len(c), n, np.int32)), pa.array(words, pa.string()), pa.array(keys), pa.array(c)], names=["lang", "n", "word", "gram", "c"])

    for b in storage.parts(batches):
        for lang, text in zip(b.column(0), b.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
        if sum(map(len, counts.values())) > 500_000:
            yield from out()
    yield from out()


class Rows:
    """Rows over the languages that hold only what differs from one value a language (``base``): a word's or n-gram's own languages."""

    def __init__(self, base: np.ndarray, begin: np.ndarray, lang: np.ndarray, more: np.ndarray) -> None:
        self.base, self.begin, self.lang, self.more = base, begin, lang, more

    @classmethod
    def of(cls, row: np.ndarray, lang: np.ndarray, log: np.ndarray, base: np.ndarray, rows: int) -> Rows:
        order = np.argsort(row, kind="stable")
        row, lang, log = row[order], lang[order], log[order]
        return cls(base, np.searchsorted(row, np.arange(rows + 1)), lang.astype(np.int32), log - base[lang])

    def __len__(self) -> int:
        return len(self.begin) - 1

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, language, difference) of all that these rows hold."""
        size = self.begin[rows + 1] - self.begin[rows]
        place = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[rows], size)
        return place, self.lang[at], self.more[at]

    def weighed(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of these rows, each n times."""
        place, lang, more = self.taken(rows)
        return n.sum() * self.base + np.bincount(lang, weights=more * n[place], minlength=len(self.base))


class Model:
    """Per-language log frequencies of words and of character n-grams.

    ``words``: word -> row of ``known``; ``tables``: size -> (sorted n-grams, their rows).
    Both keep a word's own languages only, so the model grows with its sample, not with
    words times languages.
    """

    def __init__(self, langs: list[str], words: dict[str, int], known: Rows, tables: dict[int, tuple[np.ndarray, Rows]]) -> None:
        self.langs, self.words, self.known, self.tables = langs, words, known, tables
        self._seen: dict[str, int] = {}  # unseen words scored so far
        self._scores = np.zeros((0, len(langs)))
        self._cache = min(CACHE, CELLS // max(1, len(langs)))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "words": self.words, "known": self.known, "tables": self.tables}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def backoff(self, words: list[str]) -> np.ndarray:
        """Scores of words outside the table: the mean over positions of the longest known n-gram."""
        langs = len(self.langs)
        if not words:
            return np.zeros((0, langs))
        total, seen = np.zeros(len(words) * langs), np.zeros(len(words))
        open_ = None
        for n in SIZES:
            key, of = grams(words, n)
            last = np.flatnonzero(np.r_[of[1:] != of[:-1], True])
            if open_ is None:  # the end marker starts no n-gram
                open_ = np.ones(len(of), bool)
                open_[last] = False
            known, rows = self.tables[n]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.flatnonzero(open_ & (known[at] == key) & (key != 0))
            open_[hit] = False
            here = np.bincount(of[hit], minlength=len(words))
            seen += here
            place, lang, more = rows.taken(at[hit])
            total += np.bincount(of[hit][place] * langs + lang, weights=more, minlength=len(total)) + np.outer(here, rows.base).ravel()
        return total.reshape(-1, langs) / np.maximum(seen, 1)[:, None]

    def _learn(self, words: set[str]) -> None:
        if len(self._seen) > self._cache:
            self._seen, self._scores = {}, self._scores[:0]
        new = [w for w in words if w not in self.words and w not in self._seen]
        self._seen.update(zip(new, range(len(self._seen), len(self._seen) + len(new))))
        self._scores = np.concatenate([self._scores, self.backoff(new)])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for k in range(0, len(texts), SLICE):
            counts = [Counter(words_of(t)) for t in texts[k : k + SLICE]]
            if self.langs:
                self._learn(set().union(*counts))
            out += [self._judge(c) for c in counts]
        return out

    def _judge(self, counts: Counter) -> tuple[str, float]:
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        known, base = self.words, len(self.known)
        rows = np.array([r if (r := known.get(w)) is not None else base + self._seen[w] for w in counts])
        n = np.fromiter(counts.values(), np.float64, len(counts))
        inside = rows < base
        sums = self.known.weighed(rows[inside], n[inside]) + n[~inside] @ self._scores[rows[~inside] - base]
        top = int(sums.argmax())
        return self.langs[top], float(1 / np.exp((sums - sums[top]) / n.sum()).sum())


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on at most about ``docs_per_lang`` hashed documents of each language (doc_id, text, lang)."""
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share: Column = F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_lang / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(draw < share).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, n int, word string, gram long, c long").groupBy("lang", "n", "word", "gram").agg(F.sum("c").alias("c"))
    rows = counts.toArrow()  # the words and n-grams of the sample
    langs = sorted(totals)
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
    n, c = rows.column("n").to_numpy(), rows.column("c").to_numpy()

    def table(size: int, key: np.ndarray, width: int) -> Rows:
        mine = n == size
        total = np.bincount(lang[mine], weights=c[mine], minlength=len(langs))
        return Rows.of(key, lang[mine], np.log(c[mine] / (total[lang[mine]] + 1)), np.log(0.5 / (total + 1)), width)

    words: dict[str, int] = {}
    key = np.array([words.setdefault(w, len(words)) for w in rows.filter(pa.array(n == 0)).column("word").to_pylist()], np.int64)
    known, tables = table(0, key, len(words)), {}
    gram = rows.column("gram").to_numpy().view(np.uint64)
    for size in SIZES:
        of_size, at = np.unique(gram[n == size], return_inverse=True)
        tables[size] = of_size, table(size, at, len(of_size))
    return Model(langs, words, known, tables)


def predict(docs: DataFrame, model: Model, *keep: str, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, then the language and score of each whole text under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            said = m.predict(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*keep, *names])

    schema = T.StructType([*storage.fields(docs, *keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    text = storage.unused(docs, "text_")[0]
    return storage.mapped(storage.spread(docs).select(storage.col(text_col).alias(text), *map(storage.col, keep)), run, schema)
