"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at ``THRESHOLD`` = 3 or fewer differing bits.
Split it into halves of 32: a linked pair differs in at most one bit of one half.
The anchors of a half are the covering code Golay[23,12] x F2^9: covering radius 3,
2^21 anchors. In the half where a pair differs least, one fingerprint lies within
the radius (3) of its home anchor and the other within radius plus local threshold
(3 + 1) of that same anchor. So every distinct fingerprint is replicated to all
anchors within 4 (14 a half on average), and each anchor compares its home members
with all its members on all 64 bits. No link is lost, and copies of one
fingerprint are compared once.

A wider threshold, up to 7 bits, covers four quarters with the code of all points
(radius 0): a linked pair differs in at most one bit of some quarter, so each
fingerprint goes to the anchors within radius plus local threshold (0 + 1), 17 a quarter.

Inside an anchor only a spanning forest of its links is kept (component id is all
that is asked), so a dense group of K fingerprints gives K - 1 rows, not K^2.

With a ``similarity`` a SimHash link is only a candidate: two distinct texts link if
their fingerprints do and the Jaccard similarity of their sets of ``VERIFIED`` = 5
words reaches it. A text then has two fingerprints, of its distinct words and of its
distinct pairs of words, which a few edits change least; either may link. No candidate is left out: a text with few of them is
compared pair by pair, one with more, in an anchor or in all, block against block with
all texts that it reaches by such pairs; those pairs are never listed. Members of
an anchor are ordered by the size of their sets, and only sizes that allow the
similarity are compared.

Defined results
- null and empty texts, or texts without words: fingerprint 0, linked like others
- repeated rows: same fingerprint, same component; every row is kept
- null doc_id: takes part; the smallest non-null doc_id names the component
- empty table: empty result; extra columns of the input are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import components, storage

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Fixed value: generator polynomial of the binary Golay code [23,12].
GOLAY = 0b110001110101
LINES = 256  # rows of a large anchor compared at once
BLOCK_TEXTS, BLOCK_SHINGLES = 4_096, 2_000_000  # of a dense group in one block
FEATURES = (1, 2)  # words of the features of the two fingerprints of verified links
VERIFIED = 5  # words of a shingle in the exact comparison
PAIRS = 8  # a text with more partners than this, in an anchor or in all, is compared by blocks


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words; the whole sequence if it is shorter."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def runs(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``size`` words, as tuples; the whole sequence if it is shorter."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def _majority(found: list[bytes]) -> int:
    """The bits set in over half the hashes of ``found``; 0 for none."""
    if not found:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if set in over half the hashes of all shingles."""
    return _majority(shingles((text or "").encode().lower().split(), size))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), fp (the fingerprint's bits as a signed long) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return storage.spread(docs).select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, fp long")


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp and fp2 (fingerprints of the distinct words and pairs of words), n (distinct runs of ``VERIFIED`` words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, n = np.zeros((len(FEATURES), b.num_rows), np.uint64), np.zeros(b.num_rows, np.int32)
            for i, text in enumerate(b.column(2)):
                words = (text.as_py() or "").encode().lower().split()
                fps[:, i] = [_majority([b" ".join(r) for r in runs(words, size)]) for size in FEATURES]
                n[i] = len(runs(words, VERIFIED))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, fps.view(np.int64)), pa.array(n)], names=["doc_id", "th", "fp", "fp2", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return storage.spread(docs).select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, fp long, fp2 long, n int")


class Anchors:
    """The covering code of one half and, for each syndrome, the error patterns up to radius + 1."""

    def __init__(self) -> None:
        bits = np.arange(23)
        remainder = np.zeros(23, np.int64)
        for i in bits:
            r = 1 << int(i)
            for d in range(22, 10, -1):
                if r >> d & 1:
                    r ^= GOLAY << (d - 11)
            remainder[i] = r
        weights = [np.zeros(1, np.int64)]
        for w in range(1, 5):  # each pattern of weight w adds a bit above its highest
            low, top = weights[-1], np.frexp(np.maximum(weights[-1], 0.5))[1]
            top[weights[-1] == 0] = 0
            rep = 23 - top
            start = np.repeat(np.cumsum(rep) - rep, rep)
            bit = np.arange(rep.sum()) - start + np.repeat(top, rep)
            weights.append(np.repeat(low, rep) | (1 << bit))
        patterns = np.concatenate(weights)
        far = np.repeat([0, 0, 0, 0, 1], [len(w) for w in weights])
        self.tables = [np.bitwise_xor.reduce(np.where(np.arange(256)[:, None] >> np.arange(8) & 1, np.append(remainder, [0])[8 * k : 8 * k + 8], 0), axis=1) for k in range(3)]
        s = self.syndrome(patterns)
        order = np.lexsort((far, s))  # the home pattern first
        self.patterns = patterns[order]
        self.begin = np.searchsorted(s[order], np.arange(2049))

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.tables[0][v & 255] ^ self.tables[1][v >> 8 & 255] ^ self.tables[2][v >> 16 & 127]

    def replicas(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into half, anchor, is home) of every anchor within radius + 1."""
        word, rest = half & 0x7FFFFF, half >> 23
        s = self.syndrome(word)
        first, count = self.begin[s], self.begin[s + 1] - self.begin[s]
        row = np.repeat(np.arange(len(half)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        near = word[row] ^ self.patterns[first[row] + k]
        code = np.concatenate([near << 9 | rest[row], ((word ^ self.patterns[first]) << 9 | rest)[:, None].repeat(9, 1).ravel() ^ np.tile(1 << np.arange(9), len(half))])
        return np.concatenate([row, np.repeat(np.arange(len(half)), 9)]), code, np.concatenate([k == 0, np.zeros(9 * len(half), bool)])


class Points:
    """All points of a quarter (16 bits, radius 0), for pairs within 1 bit of it."""

    def replicas(self, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = np.r_[0, 1 << np.arange(16)]
        return np.repeat(np.arange(len(quarter)), 17), (quarter[:, None] ^ near).ravel(), np.tile(near == 0, len(quarter))


def replicate(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """anchor, fp, home: every distinct fingerprint at all its anchors.

    Up to 3 bits two halves are covered by the Golay code; up to 7 bits, where a
    pair differs in at most one bit of some quarter, four quarters by all points.
    """
    if threshold > 7:
        raise ValueError("at most 7 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, parts = (Anchors(), 2) if threshold <= 3 else (Points(), 4)
        bits = 64 // parts
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), 16384):
                fp = all_fps[at : at + 16384]
                for side in range(parts):
                    part = (fp.view(np.uint64) >> np.uint64(bits * side) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    row, anchor, home = code.replicas(part)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | side << 32), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _forest(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each anchor; rows come sorted by anchor."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[start, len(anchor)])
    end = np.repeat(start + sizes, sizes)
    label, bits = np.arange(len(anchor)), fp.view(np.uint64)
    small = np.repeat(sizes <= LINES, sizes)
    for step in range(1, min(int(sizes.max(initial=1)), LINES)):
        i = np.flatnonzero(small & (np.arange(len(anchor)) + step < end))
        if not len(i):
            break
        j = i + step
        linked = (home[i] | home[j]) & (np.bitwise_count(bits[i] ^ bits[j]) <= threshold)
        components.merge_labels(label, i[linked], j[linked])
    for a, n in zip(start[sizes > LINES].tolist(), sizes[sizes > LINES].tolist()):
        mine = a + np.flatnonzero(home[a : a + n])
        for k in range(0, len(mine), LINES):
            x = mine[k : k + LINES]
            r, c = np.nonzero(np.bitwise_count(bits[x][:, None] ^ bits[a : a + n]) <= threshold)
            components.merge_labels(label, x[r], a + c)
    child = np.flatnonzero(label != np.arange(len(label)))
    return fp[child], fp[label[child]]


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: pairs of distinct fingerprints that keep everything connected that links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        rows, enough = 0, 200_000

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, rows, enough
            if not rows:
                return
            anchor, fp, home = (np.concatenate(x) for x in zip(*kept))
            cut = len(anchor) if final else int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            a, b = _forest(anchor[:cut], fp[:cut], home[:cut], threshold)
            kept, rows = [(anchor[cut:], fp[cut:], home[cut:])], len(anchor) - cut
            enough = max(200_000, 2 * rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            kept.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows > enough:
                yield from flush(False)
        yield from flush(True)

    return replicate(fps, threshold).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, th, fp, root, component_id: ``root`` is one fingerprint of each component, the id its smallest doc_id.

    Components are worked out on distinct fingerprints; documents meet them once, by
    fingerprint, and frequent fingerprints (all texts without words have one) are broadcast.
    """
    each = storage.materialize(fingerprints(docs, size), "fingerprints")
    own = storage.materialize(each.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components.connected_components(links(own.select("fp"), threshold)).select(F.col("node").alias("fp"), "root")
    rooted = storage.materialize(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-fingerprints")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    told = storage.materialize(storage.join_counted(rooted.select("root", "fp", "n"), named, "root", "members"), "named-fingerprints")
    return storage.join_counted(each, told, "fp", "n").select("doc_id", "th", "fp", "root", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``VERIFIED`` words."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles((text or "").encode().lower().split(), VERIFIED)), np.uint64))


def _near(bits: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int, similarity: float) -> np.ndarray:
    """Which pairs (i, j) may link: near fingerprints, and sets of sizes that allow the similarity."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (np.bitwise_count(bits[i] ^ bits[j]) <= threshold) & ((high == 0) | (low / np.maximum(high, 1) >= similarity))


def _span(sizes: np.ndarray, least: int, most: int, similarity: float) -> tuple[int, int]:
    """The range of sorted ``sizes`` that can reach the similarity with any size from ``least`` to ``most``."""
    return int(np.searchsorted(sizes, np.floor(least * similarity))), int(np.searchsorted(sizes, np.ceil(most / similarity), side="right"))


def _candidates(anchor: np.ndarray, th: np.ndarray, fp: np.ndarray, n: np.ndarray, home: np.ndarray, threshold: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, dense: in each anchor the pairs of texts with at most ``PAIRS`` partners there, and a spanning forest of all other pairs (dense); rows come sorted by anchor and n."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[start, len(anchor)])
    end = np.repeat(start + sizes, sizes)
    label, bits = np.arange(len(anchor)), fp.view(np.uint64)
    few = np.repeat(sizes <= LINES, sizes)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, min(int(sizes.max(initial=1)), LINES)):
        i = np.flatnonzero(few & (np.arange(len(anchor)) + step < end))
        if not len(i):
            break
        i = i[(home[i] | home[i + step]) & _near(bits, n, i, i + step, threshold, similarity)]
        left.append(i)
        right.append(i + step)
    for g in np.flatnonzero(sizes > LINES).tolist():
        a, m = int(start[g]), int(sizes[g])
        mine, held = a + np.flatnonzero(home[a : a + m]), []
        for k in range(0, len(mine), LINES):
            rows = mine[k : k + LINES]
            low, high = _span(n[a : a + m], n[rows[0]], n[rows[-1]], similarity)
            i, j = np.repeat(rows, high - low), np.tile(np.arange(a + low, a + high), len(rows))
            keep = (i != j) & ~(home[j] & (j < i)) & _near(bits, n, i, j, threshold, similarity)
            held.append((i[keep], j[keep]))
            if sum(len(x) for x, _ in held) > PAIRS * m:  # too many to hold: the forest says them
                for x, y in held:
                    components.merge_labels(label, x, y)
                held = []
        left += [x for x, _ in held]
        right += [y for _, y in held]
    i, j = np.concatenate(left), np.concatenate(right)
    degree = np.bincount(np.r_[i, j], minlength=len(anchor))
    many = np.maximum(degree[i], degree[j]) > PAIRS
    components.merge_labels(label, i[many], j[many])
    child = np.flatnonzero(label != np.arange(len(label)))
    i, j = i[~many], j[~many]
    return np.r_[th[i], th[child]], np.r_[th[j], th[label[child]]], np.r_[np.zeros(len(i), bool), np.ones(len(child), bool)]


def candidates(nodes: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """a, b (text hashes), dense: all candidate pairs; of the pairs of texts with many partners in an anchor a spanning forest."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Points()
        for b in batches:
            for at in range(0, b.num_rows, 16384):
                part = b.slice(at, 16384)
                th, *fps, n = part.columns
                for side in range(8):
                    fp = fps[side // 4]
                    row, anchor, home = code.replicas((fp.to_numpy().view(np.uint64) >> np.uint64(16 * (side % 4)) & np.uint64(0xFFFF)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | side << 32), *(c.take(pa.array(row)) for c in (th, fp, n)), pa.array(home)], names=["anchor", "th", "fp", "n", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, enough = [], 0, 200_000

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, rows, enough
            if not rows:
                return
            columns = [np.concatenate(x) for x in zip(*kept)]
            cut = rows if final else int(np.searchsorted(columns[0], columns[0][-1]))  # the last anchor may go on
            a, b, dense = _candidates(*(c[:cut] for c in columns), threshold, similarity)
            kept, rows = [tuple(c[cut:] for c in columns)], rows - cut
            enough = max(200_000, 2 * rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dense)], names=["a", "b", "dense"])

        for b in batches:
            kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            rows += b.num_rows
            if rows > enough:
                yield from flush(False)
        yield from flush(True)

    if threshold > 7:
        raise ValueError("at most 7 differing bits")
    placed = nodes.select("th", "fp", "fp2", "n").mapInArrow(spread, "anchor long, th long, fp long, n int, home boolean")
    return placed.repartition("anchor").sortWithinPartitions("anchor", "n").mapInArrow(run, "a long, b long, dense boolean").distinct()


def _by_degree(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, many): pairs of texts with at most ``PAIRS`` pairs each, and all other candidate links."""
    single = found.where("not dense").select("a", "b")
    busy = single.select(F.explode(F.array("a", "b")).alias("th")).groupBy("th").count().where(F.col("count") > PAIRS).select("th")
    told = storage.materialize(
        single.join(busy.select(F.col("th").alias("a"), F.lit(True).alias("busy_a")), "a", "left").join(busy.select(F.col("th").alias("b"), F.lit(True).alias("busy_b")), "b", "left")
        .select("a", "b", F.coalesce("busy_a", "busy_b", F.lit(False)).alias("busy")), "pairs")
    return told.where("not busy").select("a", "b"), found.where("dense").select("a", "b").unionByName(told.where("busy").select("a", "b"))


def _compared(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """task, th, side: the texts to compare, two for a pair and two blocks for a dense group.

    side: 0 against 1 between two blocks, null where all are compared with each other.
    Blocks have about ``BLOCK_TEXTS`` texts and ``BLOCK_SHINGLES`` shingles.
    """
    few, many = _by_degree(found)
    pairs = few.select(F.xxhash64("a", "b").alias("task"), F.explode(F.array("a", "b")).alias("th"), F.lit(None).cast("int").alias("side"))
    if many.isEmpty():
        return pairs
    member = storage.materialize(components.connected_components(many).join(nodes.select(F.col("th").alias("node"), "n"), "node"), "dense")
    parts = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    own = member.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    both = own.select("root", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    blocks = both.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.col("node").alias("th"), F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int")).alias("side"))
    return pairs.unionByName(blocks)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right."""
    sets = [*left, *right]
    value, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(n > 1) - 1  # hashes of one set alone are shared by none
    keep = n[place] > 1
    row, column = row[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [k, k + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _verify(bits: list[np.ndarray], side: np.ndarray, sets: list[np.ndarray], threshold: int, similarity: float) -> np.ndarray:
    """The component of each text by verified links; sides 0 and 1 are compared with each other only."""
    n, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    first, second = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    for k in range(0, len(first), LINES):
        i = first[k : k + LINES]
        for m in range(k if len(first) == len(sets) else 0, len(second), LINES):
            j = second[m : m + LINES]
            x, y = np.repeat(i, len(j)), np.tile(j, len(i))
            may = (label[x] != label[y]) & (_near(bits[0], n, x, y, threshold, similarity) | _near(bits[1], n, x, y, threshold, similarity))
            if not may.any():
                continue
            if may.sum() < LINES:
                x, y = x[may], y[may]
                common = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist())])
            else:
                common = _common([sets[p] for p in i.tolist()], [sets[q] for q in j.tolist()]).ravel()[may]
                x, y = x[may], y[may]
            alike = common >= similarity * (n[x] + n[y] - common) - 1e-9
            components.merge_labels(label, x[alike], y[alike])
    return label


def verified_links(docs: DataFrame, each: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """a, b: text hashes that keep everything connected whose link is verified; ``each`` has th, fp, fp2, n."""
    nodes = storage.materialize(each.select("th", "fp", "fp2", "n").distinct(), "texts")
    found = storage.materialize(candidates(nodes, threshold, similarity), "candidates")

    def linked(rows: list[list]) -> pa.RecordBatch:
        th, *bits = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        side = np.array([-1 if r[3] is None else r[3] for r in rows])
        label = _verify([x.view(np.uint64) for x in bits], side, [shingle_set(r[4]) for r in rows], threshold, similarity)
        child = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(th[child]), pa.array(th[label[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for b in batches:
            for t, *row in zip(*(c.to_pylist() for c in b.columns)):
                if t != task and rows:
                    yield linked(rows)
                    rows = []
                task = t
                rows.append(row)
        if rows:
            yield linked(rows)

    members = storage.materialize(_compared(found, nodes).distinct(), "compared")
    texts = docs.select(F.xxhash64("text").alias("th"), "text").groupBy("th").agg(F.first("text").alias("text")).join(members.select("th").distinct(), "th", "left_semi")
    told = members.join(texts, "th").join(nodes.select("th", "fp", "fp2"), "th").select("task", "th", "fp", "fp2", "side", "text")
    return told.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def verified_groups(docs: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """doc_id, th, root: ``root`` is one text's hash of each component of verified links."""
    each = storage.materialize(profiles(docs), "profiles")
    roots = components.connected_components(verified_links(docs, each, threshold, similarity)).select(F.col("node").alias("th"), "root")
    copies = each.groupBy("th").agg(F.count("*").alias("n"))
    told = storage.materialize(copies.join(roots, "th", "left").select("th", "n", F.coalesce("root", "th").alias("root")), "rooted-texts")
    return storage.join_counted(each.select("doc_id", "th"), told, "th", "n").select("doc_id", "th", "root")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    return groups(docs, size, threshold).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, similarity: float | None = None) -> DataFrame:
    """One row of each component, with its columns as they were: the smallest non-null doc_id.

    Of several texts with that id the one with the least hash stays, of repeated rows any one.
    With a ``similarity`` links are verified, and ``FEATURES`` stand for ``size``.
    """
    grouped = groups(docs, size, threshold) if similarity is None else verified_groups(docs, threshold, similarity)
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th")).distinct()
    th = storage.unused(docs, "th")[0]
    keyed = docs.withColumn(th, F.xxhash64("text"))
    chosen = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["kept_id"]) & (keyed[th] == kept["kept_th"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", th]).drop(th)
