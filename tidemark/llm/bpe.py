"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one BPE encoding, and so one last token. An automaton over
the vocabulary names all tokens that end at a position; the last token of that prefix is
the one among them that is compatible with the last token of the prefix before it.
Two tokens are compatible if the merges, run over their joined symbols, leave just
these two; that is told by undoing merges along their seam, latest first. Following the
stored tokens back from the end of the word gives its exact ids, in time linear in the
word, whatever its length.

The tokenizer's own normaliser and word splitting come from its library (Latin letters
below U+0250, which no composition changes, are lower-cased and split here by the
tokenizer's own pattern, where that is all it does); the merges are run here. Where words
never cross white space (told by a probe), texts are cut at white space first. Each
Python worker keeps a table of the pieces it has met, in two generations of ``TABLE``
entries or ``TABLE_BYTES`` bytes at most, of which the older goes: memory is bounded and
results do not depend on it. The driver derives how each token of the vocabulary is merged, once;
its size is that of the vocabulary file.

Defined results
- null text: encoded as the empty text (no ids, decodes to "")
- strings of special tokens inside a text become their ids, as the library has it
- repeated rows are encoded alike and kept; very long texts and words whole
- an empty table gives an empty result; other columns are not read
- vocabularies with a byte fallback, dropout, unknown token, a prefix inside words,
  without some byte, or with merges that are not in order of making are refused
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import storage

TABLE = 200_000
TABLE_BYTES = 80_000_000
BATCH = 64  # texts whose new pieces are encoded together
LONG = 256  # longer pieces are encoded without being kept
PAIRS = 500_000  # remembered compatibility tests
LATIN = "\u0250"  # the first letter that the library normalises
END = "\0"  # stands for the mark at a word's end; byte symbols never hold it
NOT_SPACE = "\x1c\x1d\x1e\x1f"  # split() takes these for white space, tokenizers do not
PROBE = " a  b's\tc1 2\n ① ﬁ Å\r\n..x !? 'tis 'S　z "


def run_merges(symbols: list[str], rank: dict[tuple[str, str], int]) -> tuple[list[str], tuple[str, str] | None]:
    """What the merges leave of ``symbols``, and the last pair merged: lowest rank first, then leftmost."""
    last = None
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return symbols, last
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


class Vocabulary:
    """A tokenizer file as tables: ids, merge ranks, and how each token is merged."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        model = json.loads(self.text)["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model['type']} {odd}")
        self.mark = model.get("end_of_word_suffix") or ""
        self.ids = {self._own(t): i for t, i in model["vocab"].items()}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.rank = {(self._own(a), self._own(b)): n for n, (a, b) in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str]] = {}
        made = {a + b for a, b in self.rank}
        for token in made:
            whole, last = run_merges(self.symbols(token), self.rank)
            if whole == [token]:
                self.parts[token] = last
        of = lambda t: self.rank[self.parts[t]] if t in self.parts else -1
        if any(max(of(a), of(b)) >= self.rank[a, b] for a, b in self.parts.values()):
            raise ValueError("the merges are not in the order in which tokens are made")

    def _own(self, token: str) -> str:
        return token[: -len(self.mark)] + END if self.mark and token.endswith(self.mark) else token

    @staticmethod
    def symbols(token: str) -> list[str]:
        """Single characters; the last keeps the mark of the word's end."""
        return [*token[:-2], token[-2:]] if token.endswith(END) else [*token]


def _plain_split(tokenizer: dict) -> regex.Pattern | None:
    """The pattern that finds words, if a tokenizer does no more than compose, lower-case and find them."""
    before = (tokenizer.get("normalizer") or {}).get("normalizers", [])
    steps = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])
    lower = [n["type"] for n in before] == ["NFC", "Replace", "Lowercase"] and before[1]["pattern"] == {"Regex": r"\s+"} and before[1]["content"] == " "
    found = [p["type"] for p in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "Regex" in steps[0]["pattern"]
    plain = found and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex", True)
    return regex.compile(steps[0]["pattern"]["Regex"]) if lower and plain else None


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with one vocabulary and one table of pieces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.lib = Tokenizer.from_str(v.text)
        self.mark = v.mark
        name = {i: t for t, i in v.ids.items()}
        self.rank = {(v.ids[a], v.ids[b]): n for (a, b), n in v.rank.items() if a in v.ids and b in v.ids}
        self.parts = {v.ids[t]: (v.ids[a], v.ids[b]) for t, (a, b) in v.parts.items() if t in v.ids}
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        self.automaton, self.whole = ahocorasick.Automaton(), {}
        self.width, self.sizes = max(name) + 1, [0] * (max(name) + 1)
        for token, i in v.ids.items():
            if i in self.parts or len(v.symbols(token)) == 1:  # what no merge makes is never emitted
                self.automaton.add_word(token, i)
                self.whole[token], self.sizes[i] = [i], len(token)
        self.automaton.make_automaton()
        self.split, self.symbol = _plain_split(json.loads(v.text)), byte_symbols()
        added = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.lib.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that are normalised or strip white space are not supported")
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.by_space = self.lib.encode(PROBE, add_special_tokens=False).ids == [*chain.from_iterable(self.lib.encode(c, add_special_tokens=False).ids for c in PROBE.split())]
        self.words: dict[str, list[int]] = {}
        self.table: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.bytes = 0
        self.pairs: dict[int, bool] = {}
        self.shown = [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size())]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they stand side by side."""
        key = left * self.width + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        # Twice the rank of the merge undone last, plus one if it lies right of the seam: at equal
        # rank the leftmost pair merges first, so the seam wins against the right side only.
        until = float("inf")
        made = self.made
        while True:
            seam = self.rank.get((left, right))
            if seam is not None and 2 * seam < until:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if b >= a:
                until, right = 2 * b + 1, self.parts[right][0]
            else:
                until, left = 2 * a, self.parts[left][1]

    def of_word(self, word: str) -> list[int]:
        """The ids of one word of byte symbols."""
        text = word + END if self.mark else word
        known = self.whole.get(text) or self.words.get(word)
        if known is not None:
            return known
        last, sizes, compatible, pairs, width = [-1] * (len(text) + 1), self.sizes, self.compatible, self.pairs, self.width
        for at, token in self.automaton.iter(text):  # every token that ends here, the longest first
            if last[at + 1] < 0:
                start = at + 1 - sizes[token]
                if start:
                    left = last[start]
                    if left < 0:
                        continue
                    fits = pairs.get(left * width + token)
                    if fits is None:
                        fits = compatible(left, token)
                    if not fits:
                        continue
                last[at + 1] = token
        ids, end = [], len(text)
        while end:
            if last[end] < 0:
                raise ValueError(f"the vocabulary lacks a symbol of {word[:40]!r}")
            ids.append(last[end])
            end -= sizes[last[end]]
        ids.reverse()
        if len(word) <= LONG:
            if len(self.words) >= TABLE:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        """The words of a text as byte symbols."""
        if self.split and text and max(text) < LATIN:
            text = text.lower()
            found = [text] if text.isalpha() else self.split.findall(text)
            return found if text.isascii() and text.isprintable() else [w.encode().decode("latin-1").translate(self.symbol) for w in found]
        text = self.lib.normalizer.normalize_str(text) if self.lib.normalizer else text
        return [word for word, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[int]:
        words = self._words(text)
        return self.of_word(words[0]) if len(words) == 1 else [i for w in words for i in self.of_word(w)]

    def _ids(self, text: str) -> list[int]:
        """The ids of a text, by words; special tokens are cut out first."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return [i for part in self.special.split(text) if part for i in ([self.added[part]] if part in self.added else self._plain(part))]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode of all ids; a vocabulary without decoder shows its tokens, parted by spaces."""
        if self.lib.decoder is not None:
            return self.lib.decode([*ids], skip_special_tokens=False)
        return " ".join(map(self.shown.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[int, str, str]:
        ids = self._ids(piece)
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.shown.__getitem__, ids))

    def _pieces(self, text: str) -> list[str]:
        if any(c in text for c in NOT_SPACE):
            return [p for p in re.split(f"[^\\S{NOT_SPACE}]+", text) if p]
        return text.split()

    def encode(self, text: str) -> list[int]:
        """The ids of one whole text."""
        if not self.by_space:
            return self._ids(text)
        return [int(i) for _, ids, _ in self._looked_up([self._pieces(text)])[0] if ids for i in ids.split(" ")]

    def _looked_up(self, split: list[list[str]]) -> list[list[tuple[int, str, str]]]:
        """For each text the table's entries of its pieces: number of ids, ids and tokens as text."""
        if len(self.table) >= TABLE or self.bytes > TABLE_BYTES:
            self.table, self.older, self.bytes = {}, self.table, 0
        long = {}
        for p in set().union(*split).difference(self.table):
            if len(p) <= LONG:
                entry = self.table[p] = self.older.get(p) or self._piece(p)
                self.bytes += 2 * len(p) + len(entry[1]) + 2 * len(entry[2]) + 300
            else:
                long[p] = self._piece(p)
        of = self.table.__getitem__
        return [[*map(of, pieces)] if not long else [long[p] if p in long else of(p) for p in pieces] for pieces in split]

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each whole text: number of ids, ids as text, decoded text."""
        if not self.by_space or self.lib.decoder is not None:
            for t in texts:
                ids = self.encode(t)
                yield len(ids), " ".join(map(str, ids)), self.decode(ids)
            return
        count, ids, tokens = itemgetter(0), itemgetter(1), itemgetter(2)
        for found in self._looked_up([self._pieces(t) for t in texts]):
            found = found if all(map(count, found)) else [*filter(count, found)]  # a piece of nothing shows nothing
            yield sum(map(count, found)), " ".join(map(ids, found)), " ".join(map(tokens, found))


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker, by vocabulary
_VOCABULARIES: dict[str, Vocabulary] = {}  # of the driver, by file


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _encoder(shared) -> Encoder:
    """This worker's encoder: building the automaton costs more than most tasks."""
    key = hashlib.sha256(shared.value.text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _over(df: DataFrame, path: str, column: str, keep: tuple[str, ...], made: str, of) -> DataFrame:
    """The columns ``keep`` and ``made``; ``of(encoder, values)`` gives a row for each value of ``column``."""
    shared = df.sparkSession.sparkContext.broadcast(_vocabulary(path))
    extra = T.StructType.fromDDL(made)
    schema = T.StructType([*storage.fields(df, *keep), *extra])
    types = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoder(shared)
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                rows = list(of(enc, part.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=schema.names)

    first = storage.unused(df, "read")[0]
    return storage.mapped(storage.spread(df).select(storage.col(column).alias(first), *map(storage.col, keep)), run, schema)


def encode(docs: DataFrame, path: str, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ids (array<int>) of each whole text; ``path`` is a tokenizer file."""
    return _over(docs, path, text_col, keep, "ids array<int>", lambda enc, texts: ((enc.encode(t or ""),) for t in texts))


def decode(encoded: DataFrame, path: str, *keep: str, ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` with the text of each row's ids; null ids give the empty text."""
    return _over(encoded, path, ids_col, keep, "text string", lambda enc, rows: ((enc.decode(i or []),) for i in rows))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def round_trip(docs: DataFrame, path: str, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass."""
    return _over(docs, path, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                 lambda enc, texts: ((n, _digest(ids), _digest(text)) for n, ids, text in enc.round_trips([t or "" for t in texts])))
