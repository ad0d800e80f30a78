"""Exact removal of repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is
removed. Strings are bucketed and the buckets refined until equal bucket means equal
string; every decision is made on bytes, hashes only deal rows out:

1. Each window of LENGTH bytes points to one q-gram inside it (q = LENGTH / 2): the
   one with the least hash, the leftmost of equals. Equal windows point to equal
   q-grams at the same offset, so a window can only repeat inside the bucket of its
   q-gram. Neighbouring windows mostly share their pointer; one row stands for each
   run of windows with the same pointer. A bucket with one row is finished.
2. Rows of the other buckets get their stretch of bytes (less than 1.5 LENGTH) and are
   refined bucket by bucket: 8-byte words are the first bucket identifiers, then
   positions are sorted by the pair (own bucket, bucket ``depth`` bytes later), each
   step's identifiers feeding the next, until the depth is LENGTH.

Skew: stretches that a task meets again among ``HELD`` rows are compared there, byte by
byte, and only the first goes on. A q-gram with many different stretches around it is
refined before it is dealt: its windows go by slices of their offset, each under the
bytes that all windows of the slice share. Which q-grams are split is told by a hashed
sample of the documents; it changes where rows meet, never what is found.

Text is shuffled twice, to the rows of shared buckets and to the found windows; all
other rows are fixed-size numbers or stretches.

Defined results
- null text: no bytes, nothing removed; texts under LENGTH bytes are kept whole
- exact copies (repeated rows included) of LENGTH bytes or more lose all their bytes
- matches never cross rows; a row's key is a 128-bit hash of doc_id and text, so null
  and repeated doc_id are safe
- an empty table gives an empty result; other columns are not read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import storage

LENGTH = 200
HELD = 100_000  # rows in which a task looks for repeated stretches before it passes them on
SAMPLE = 64  # one document of so many tells which q-grams to split
SPLIT = 2_000  # estimated different stretches of a q-gram beyond which it is split
MAX_SPLIT = 100_000  # q-grams in the split table, most frequent first; bounds what is broadcast
PACK = 20  # bits of a packed position that hold the run's length
_BASE = 0x9E3779B97F4A7C15 | 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of ``data`` (uint8)."""
    up, down = POWERS.get(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[q:] - total[:-q]) * down[: len(data) - q + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, pointed q-gram) of each run of windows with one pointer."""
    q = length // 2
    if len(text) < length:
        return (np.empty(0, np.int64),) * 3
    h = gram_hashes(np.frombuffer(text, np.uint8), q)
    least = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, length - q + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.r_[first[1:] - 1, len(at) - 1], at[first]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _merged(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring runs of windows of the same row, joined: (row, first, windows)."""
    order = np.lexsort((first, row))
    row, first, count = row[order], first[order], count[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (first[1:] != first[:-1] + count[:-1])]) if len(row) else np.empty(0, np.int64)
    total = np.add.reduceat(count, new) if len(new) else new
    return row[new], first[new], total


def _packed(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, at): runs of windows as one number each; runs too long for one number are cut."""
    most = 1 << PACK
    n = -(-count // most)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, first, count = (np.repeat(x, n) for x in (row, first, count))
    return row, first + k * most << PACK | np.minimum(count - k * most, most) - 1


def _slices(text: bytes, first: int, last: int, at: int, parts: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of a run split by the window's distance before its q-gram."""
    q = length // 2
    room = length - q  # the greatest distance
    for p in range(parts):
        low, high = -(-p * (room + 1) // parts), -(-(p + 1) * (room + 1) // parts) - 1
        f, w = max(first, at - high), min(last, at - low)
        if f <= w:
            yield xxhash.xxh3_64_intdigest(text[at - low : at + q + room - high], p + 1), f, w


def split_table(keyed: DataFrame, length: int) -> dict[int, int]:
    """q-gram hash -> slices, for the q-grams that a sample finds among many different stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, q = xxhash.xxh3_64_intdigest, length // 2
        for b in batches:
            for t in b.column(0):
                text = (t.as_py() or "").encode()
                first, last, at = runs(text, length)
                yield pa.RecordBatch.from_arrays([
                    _signed([digest(text[i : i + q]) for i in at.tolist()]), _signed([digest(text[i:j]) for i, j in zip(first.tolist(), (last + length).tolist())])], names=["gram", "stretch"])

    found = keyed.where(F.pmod("k1", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "gram long, stretch long").distinct()
    often = found.groupBy("gram").count().where(F.col("count") * SAMPLE > SPLIT).orderBy(F.desc("count"), "gram").limit(MAX_SPLIT)
    size = lambda n: 4 if n < 16 * SPLIT else 16 if n < 256 * SPLIT else length - length // 2 + 1
    return {r["gram"] & (1 << 64) - 1: size(r["count"] * SAMPLE) for r in often.collect()}


def bucket_rows(keyed: DataFrame, length: int, split: dict[int, int]) -> DataFrame:
    """gram, k1, k2, at, done: one row for each run of each document; done: its windows are known to repeat."""
    q = length // 2
    shared = keyed.sparkSession.sparkContext.broadcast(split)  # at most MAX_SPLIT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, hot = xxhash.xxh3_64_intdigest, shared.value
        seen: dict[bytes, int] = {}  # stretch -> its row in the lists below, negative once it is known to repeat
        gram, k1, k2, first, count = [], [], [], [], []
        again: list[tuple[int, int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal again
            f, n = np.array(first, np.int64), np.array(count, np.int64)
            yield pa.RecordBatch.from_arrays([_signed(gram), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(f << PACK | n - 1), pa.array(np.zeros(len(f), bool))], names=names)
            twice = [-i - 1 for i in seen.values() if i < 0]
            keys = [(k1[i], k2[i]) for i in twice] + [(a, b) for a, b, _, _ in again]
            place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            row = np.array([place[k] for k in keys], np.int64)
            row, at = _packed(*_merged(row, np.r_[f[twice], np.array([x[2] for x in again], np.int64)].astype(np.int64), np.r_[n[twice], np.array([x[3] for x in again], np.int64)].astype(np.int64)))
            a, b = (np.array(x, np.int64) for x in zip(*place)) if place else (np.empty(0, np.int64),) * 2
            own = (a[row].view(np.uint64) ^ at.view(np.uint64)) * np.uint64(_BASE)  # dealt anywhere
            yield pa.RecordBatch.from_arrays([pa.array((own ^ own >> np.uint64(31)).view(np.int64)), pa.array(a[row]), pa.array(b[row]), pa.array(at), pa.array(np.ones(len(at), bool))], names=names)
            seen.clear()
            again = []
            for x in (gram, k1, k2, first, count):
                x.clear()

        names = ["gram", "k1", "k2", "at", "done"]
        for b in batches:
            for x, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = (t.as_py() or "").encode()
                for f, w, a in zip(*(z.tolist() for z in runs(text, length))):
                    g = digest(text[a : a + q])
                    for g, i, j in (_slices(text, f, w, a, hot[g], length) if g in hot else ((g, f, w),)):
                        stretch = text[i : j + length]
                        old = seen.get(stretch)
                        if old is None:
                            seen[stretch] = len(gram)
                            gram.append(g)
                            k1.append(x)
                            k2.append(y)
                            first.append(i)
                            count.append(j - i + 1)
                        else:
                            again.append((x, y, i, j - i + 1))
                            if old >= 0:
                                seen[stretch] = -old - 1
                    if len(gram) + len(again) >= HELD:
                        yield from flush()
        yield from flush()

    return keyed.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, at long, done boolean")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows that are done, and those of buckets with at least two rows."""
    members = F.sum(F.when(F.col("done"), 0).otherwise(1)).over(Window.partitionBy("gram"))
    return rows.repartition("gram").withColumn("members", members).where("done or members > 1").drop("members")


def refine(buffer: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each place in ``own`` has an equal at another of them.

    Strings that leave their stretch get buckets too; no place in ``own`` asks for them.
    """
    depth = min(8, length)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buffer),), "<u8", np.ascontiguousarray(padded), 0, (1,))
    if depth < 8:
        words = words & np.uint64((1 << 8 * depth) - 1)
    if depth == length:
        words = words[own]
    bucket = np.unique(words, return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        last = depth + step == length
        left = bucket[own] if last else bucket[: len(bucket) - step]
        right = bucket[own + step] if last else bucket[step:]
        bucket = np.unique(left * np.int64(len(bucket) + 1) + right, return_inverse=True)[1]
        depth += step
    return np.bincount(bucket)[bucket] > 1


def _decide(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, windows): the repeated runs of windows of whole buckets."""
    at, gram = t.column("at").to_numpy(), t.column("gram").to_numpy()
    first, counts = at >> PACK, (at & (1 << PACK) - 1) + 1
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(s, len(seen)) for s in t.column("bytes").to_pylist()])
    lone = np.bincount(which)[which] == 1
    leader = np.unique(which, return_index=True)[1]  # one row of each stretch
    _, bucket = np.unique(gram[leader], return_inverse=True)
    mixed = np.flatnonzero(np.bincount(bucket)[bucket] > 1)  # stretches with others in their bucket
    full = np.flatnonzero(~lone)
    row, start, n = [full], [first[full]], [counts[full]]
    if len(mixed):
        parts = list(seen)
        parts = [parts[i] for i in mixed]
        sizes = np.array([len(p) for p in parts])
        begin, windows = np.cumsum(sizes) - sizes, sizes - length + 1
        of = np.repeat(np.arange(len(mixed)), windows)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        yes = refine(np.frombuffer(b"".join(parts), np.uint8), begin[of] + offset, length) & lone[leader[mixed]][of]
        mine = leader[mixed][of[yes]]
        row.append(mine)
        start.append(first[mine] + offset[yes])
        n.append(np.ones(len(mine), np.int64))
    return _merged(*(np.concatenate(x) for x in (row, start, n)))


def _refined(length: int):
    """Repeated windows of rows that come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, enough = 0, 2_000_000

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, enough
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            cut = len(gram) if final else int(np.searchsorted(gram, gram[-1]))  # the last bucket may go on
            if cut:
                done = t.slice(0, cut).combine_chunks()
                row, at = _packed(*_decide(done, length))
                yield from pa.table([*done.select(["k1", "k2"]).take(pa.array(row)).columns, pa.array(at)], names=["k1", "k2", "at"]).combine_chunks().to_batches()
            rest = t.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
            enough = max(2_000_000, 2 * size)

        for b in batches:
            for k in range(0, b.num_rows, 4096):
                held.append(b.slice(k, 4096))
                size += held[-1].nbytes
                if size > enough:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def decided(probed: DataFrame, length: int) -> DataFrame:
    """k1, k2, at: repeated windows among the rows of shared buckets (k1, k2, text, probes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = (b.column("text")[i].as_py() or "").encode()
                p = b.column("probes")[i].values
                at = p.field("at").to_numpy()
                for k in range(0, len(at), 4096):
                    a = at[k : k + 4096]
                    first = a >> PACK
                    keys = [pa.array(np.full(len(a), b.column(c)[i].as_py(), np.int64)) for c in ("k1", "k2")]
                    stretches = pa.array([text[x:y] for x, y in zip(first.tolist(), (first + (a & (1 << PACK) - 1) + length).tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([p.field("gram").slice(k, 4096), *keys, pa.array(a), stretches], names=["gram", "k1", "k2", "at", "bytes"])

    cuts = probed.select("k1", "k2", "text", "probes").mapInArrow(cut, "gram long, k1 long, k2 long, at long, bytes binary")
    return cuts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_refined(length), "k1 long, k2 long, at long")


def covered(n: int, ats: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows, given as packed runs of window starts."""
    out: list[tuple[int, int]] = []
    for a in sorted(ats):
        start, stop = a >> PACK, (a >> PACK) + (a & (1 << PACK) - 1) + length
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def repeated(docs: DataFrame, *keep: str, length: int = LENGTH) -> DataFrame:
    """The columns ``keep`` and text, all under their own names, with ``ats`` as the last: packed runs of repeated windows."""
    names = list(dict.fromkeys([*keep, "text"]))
    n1, n2 = storage.unused(docs, "k1_", "k2_")
    keyed = docs.select(*map(storage.col, names), F.xxhash64("doc_id", "text").alias(n1), F.xxhash64("text", "doc_id").alias(n2))
    plain = keyed.select(storage.col(n1).alias("k1"), storage.col(n2).alias("k2"), "text")
    rows = bucket_rows(plain, length, split_table(plain, length))
    of_doc = storage.materialize(
        shared_buckets(rows).groupBy("k1", "k2").agg(
            F.collect_list(F.when(F.col("done"), F.col("at"))).alias("full"),
            F.collect_list(F.when(~F.col("done"), F.struct("gram", "at"))).alias("probes")), "repeats")
    probed = of_doc.where(F.size("probes") > 0)
    found = decided(plain.join(probed.select("k1", "k2", "probes"), ["k1", "k2"]), length).groupBy("k1", "k2").agg(F.collect_list("at").alias("more"))
    none = F.array().cast("array<bigint>")
    # written before the text is dealt once more, so that what the first dealing left can go
    ats = storage.materialize(of_doc.select("k1", "k2", "full").join(found, ["k1", "k2"], "left").select("k1", "k2", F.concat("full", F.coalesce("more", none)).alias("ats_")), "runs")
    storage.drop(of_doc)
    out = keyed.join(ats, (keyed[n1] == ats["k1"]) & (keyed[n2] == ats["k2"]), "left")
    return out.select(*[keyed[_quoted(c)] for c in names], F.coalesce(ats["ats_"], none).alias(storage.unused(docs, "ats")[0]))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, ats in zip(b.column(1), b.column(2)):
                text, kept, at = (t.as_py() or "").encode(), hashlib.sha256(), 0
                spans = covered(len(text), ats.as_py(), length)
                for start, stop in spans:
                    kept.update(text[at:start])
                    at = stop
                kept.update(text[at:])
                rows.append((len(text), sum(y - x for x, y in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([*storage.fields(docs, "doc_id"), *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string")])
    return storage.mapped(repeated(storage.spread(docs), "doc_id", length=length), run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text`` and its other columns as they were.

    A character that is partly removed goes as a whole. Texts that repeat nothing,
    nulls included, are unchanged.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, ats in zip(b.column("text"), b.column(b.num_columns - 1)):
                text, at = t.as_py(), ats.as_py()
                if at:
                    raw, kept, last = text.encode(), [], 0
                    for start, stop in covered(len(raw), at, length):
                        kept.append(raw[last:start])
                        last = stop
                    text = b"".join(x.decode(errors="ignore").encode() for x in [*kept, raw[last:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    return storage.mapped(repeated(storage.spread(docs), *names, length=length), run, docs.schema)
