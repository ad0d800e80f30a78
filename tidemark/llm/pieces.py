"""SentencePiece encoding and decoding through a table of distinct chunks.

A BPE piece of the model holds whitespace markers only at its start, so no merge
crosses from a word into the next marker: a text splits into marked words (markers,
then the characters up to the next marker) that are segmented independently. Each
task keeps a table of the distinct marked words it has met, segments every new one
once with the library, and joins the ids back by position.

The table belongs to the task: a table of all words shared by all tasks would need
every word occurrence to be shuffled twice, more than the text itself. It holds at
most ``TABLE`` words and ``TABLE_BYTES`` bytes and starts afresh beyond that, so
memory is bounded and results do not depend on it.

Models that normalise text, or whose pieces cross markers, are detected on the
driver and encoded text by text instead.

Defined results
- null text: encoded as the empty text (the end id alone; decodes to "")
- repeated rows are encoded alike and kept; very long texts and words whole
- an empty table gives an empty result; other columns are not read
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import storage

MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
TABLE = 200_000
TABLE_BYTES = 48_000_000
BATCH = 256  # texts whose new words are segmented together
LONG = 256  # longer marked words are segmented without being kept


def splits_at_markers(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether distinct marked words can be segmented on their own, exactly as inside a text."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)):
        return False
    probe = "  a b  ﬁ ÅÅ\t\n①  "
    return sp.encode("a b") != sp.encode(" a b") and sp.decode(sp.encode(probe)) == probe


class Encoder:
    """Encodes texts with one table of distinct marked words."""

    def __init__(self, model: bytes) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_chunk = splits_at_markers(self.sp)
        self.end = self.sp.eos_id()
        self.space = [self.sp.piece_to_id(MARK)]
        self.table: dict[str, list[int]] = {}
        self.bytes = 0

    def _learn(self, chunks: set[str]) -> dict[str, list[int]]:
        """Segment marked words that the table lacks; the result holds the long ones, not kept."""
        new = [c for c in chunks if c not in self.table]
        ids = self.sp.encode([c[1:] for c in new], num_threads=1) if new else []  # the library adds the first marker
        ids = [i if len(c) > 1 else self.space for c, i in zip(new, ids)]
        self.bytes += sum(2 * len(c) + 8 * len(i) for c, i in zip(new, ids) if len(c) <= LONG)
        self.table.update((c, i) for c, i in zip(new, ids) if len(c) <= LONG)
        return {c: i for c, i in zip(new, ids) if len(c) > LONG}

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The library's ids of each whole text, then the end id."""
        if not self.by_chunk:
            for ids in self.sp.encode(texts, num_threads=1):
                yield [*ids, self.end]
            return
        if len(self.table) >= TABLE or self.bytes > TABLE_BYTES:
            self.table.clear()
            self.bytes = 0
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        long = self._learn(set().union(*split))
        of, of_long = self.table.__getitem__, long.__getitem__
        for chunks in split:
            ids = list(chain.from_iterable(map(of, chunks))) if not long else [i for c in chunks for i in (of(c) if len(c) <= LONG else of_long(c))]
            ids.append(self.end)
            yield ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _model_bytes(df: DataFrame, path: str) -> bytes:
    """The model file, read once on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def _lists(rows: list[pa.Array]) -> pa.Array:
    """One list<int> array from packed rows."""
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.concat_arrays(rows) if rows else pa.array([], pa.int32()))


def _over(df: DataFrame, run, column: str, keep: tuple[str, ...], made: str) -> DataFrame:
    """``run`` over ``column`` and the columns ``keep``; it gives ``keep`` and the columns ``made``."""
    schema = T.StructType([*storage.fields(df, *keep), *T.StructType.fromDDL(made)])
    first = storage.unused(df, "read")[0]
    return storage.mapped(storage.spread(df).select(storage.col(column).alias(first), *map(storage.col, keep)), run, schema)


def encode(docs: DataFrame, model_path: str, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ids (array<int>) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(docs, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                ids = pa.array(list(enc.encode_all([t.as_py() or "" for t in part.column(0)])), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], names=[*keep, "ids"])

    return _over(docs, run, text_col, keep, "ids array<int>")


def decode(encoded: DataFrame, model_path: str, *keep: str, ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` with the text of each row's ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_model_bytes(encoded, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            texts = pa.array([enc.decode(i.as_py() or []) for i in b.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], texts], names=[*keep, "text"])

    return _over(encoded, run, ids_col, keep, "text string")


def round_trip(docs: DataFrame, model_path: str, *keep: str, text_col: str = "text", whole: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass.

    ``whole`` adds the ids themselves and the text that they decode to (ids, decoded).
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(docs, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            n, of_ids, of_text, coded, decoded = [], [], [], [], []
            for at in range(0, b.num_rows, BATCH):
                for ids in enc.encode_all([t.as_py() or "" for t in b.column(0).slice(at, BATCH)]):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    text = enc.decode(ids)
                    of_text.append(hashlib.sha256(text.encode()).hexdigest())
                    if whole:
                        coded.append(pa.array(ids, pa.int32()))
                        decoded.append(text)
            more = [_lists(coded), pa.array(decoded, pa.string())] if whole else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), *more], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: len(more)]])

    return _over(docs, run, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole)
