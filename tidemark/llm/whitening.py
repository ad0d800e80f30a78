"""Embedding whitening by spectrum slicing.

The covariance is summed exactly: entries become whole numbers, tasks sum products of
entries less a whole number near their mean, and the driver corrects by the exact rest.
The number of negative pivots of LDL^T of the covariance less a shift counts the
eigenvalues below the shift, so halving an interval isolates each leading eigenvalue.
Rayleigh quotient iteration, kept in that interval, converges cubically to its vector,
and counts on both sides of the found value certify its number. Where eigenvalues are
equal to rounding, no shift parts them: their space is taken from solves orthogonal to
the vectors already found, and the counts certify the whole cluster.

The driver holds matrices of the square of the dimension, whatever the number of rows.

Defined results
- vectors null, or holding null or non-finite entries, are dropped; a null id is kept
- entries that a vector lacks against the longest one count as zero
- repeated rows count each time
- directions without variance have no component (fewer than ``count`` then); equal
  rows only, one row, or an empty table give an empty result
- entries whose whole number exceeds 2^40 in size are refused with an error
- a deviation beyond 64 bits is null; other columns are not read
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage
from tidemark.llm.topk import usable

SCALE, OFFSET = 1024, 100_000
LIMIT = 2**40
FAR = 2.0**62  # partial sums are sent before they can pass this
GOLDEN = (1 + math.sqrt(5)) / 2


# Counting and finding eigenvalues (driver, d x d) -------------------------------------------

def below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below ``shift``: negative pivots of LDL^T.

    Pivots are single entries, or blocks of two where the diagonal is too small for
    them (both chosen by size among what is left, as Bunch and Parlett do).
    """
    a = np.array(matrix, float)
    a[np.diag_indices_from(a)] -= shift
    negative, alpha, tiny = 0, (1 + math.sqrt(17)) / 8, 1e-300
    while len(a):
        diagonal = np.abs(a.diagonal())
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= alpha * off[i, j]:
            pivot = a[p, p]
            negative += pivot < 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)]
            if abs(pivot) > tiny:
                a = a - np.outer(column, column / pivot)
        else:
            negative += 1  # a block of two without weight on its diagonal has one eigenvalue of each sign
            rest = np.delete(np.arange(len(a)), [i, j])
            block, column = a[np.ix_([i, j], [i, j])], a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - column @ np.linalg.solve(block, column.T)
        a = (a + a.T) / 2
    return negative


def _outside(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for f in found:
            vector = vector - f * (f @ vector)
    return vector


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, size: float) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, right)
    except np.linalg.LinAlgError:
        return np.linalg.solve(shifted + np.eye(len(matrix)) * size * 2.0**-52, right)


def leading(matrix: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest positive eigenvalues with unit vectors, by falling eigenvalue, certified.

    Each sign is chosen so that the entry of largest size is positive.
    """
    d = len(matrix)
    if not d or not matrix.any():
        return []
    size = float(np.abs(matrix).sum(1).max())  # no eigenvalue is larger
    noise = d * size * 2.0**-50
    above: dict[float, int] = {}

    def over(shift: float) -> int:
        if shift not in above:
            above[shift] = d - below(matrix, shift)
        return above[shift]

    rank = min(count, over(noise))
    out: list[tuple[float, np.ndarray]] = []
    start = np.array([math.cos(GOLDEN * (i + 1) ** 1.5) for i in range(d)])
    for k in range(1, rank + 1):
        low, high = max((s for s in above if above[s] >= k), default=0.0), min((s for s in above if above[s] < k), default=size * (1 + 2.0**-40))
        while over(low) - (over(high) if high < size else 0) > 1 and high - low > noise:
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) >= k else (low, middle)
        found = [v for _, v in out]
        value, vector = (low + high) / 2, _outside(start, found)
        vector = vector / np.linalg.norm(vector)
        for step in range(200):
            ahead = _outside(_solve(matrix, value, vector, size), found)
            vector = ahead / np.linalg.norm(ahead)
            quotient = float(vector @ matrix @ vector)
            missed = float(np.linalg.norm(matrix @ vector - quotient * vector))
            if missed <= noise / 8 and low - noise <= quotient <= high + noise:
                break
            inside = low <= quotient <= high and missed <= min(quotient - low, high - quotient, (high - low) / 4)
            if inside:
                value = quotient  # from here on the quotient converges cubically
            else:  # not yet in the interval's own basin: the shift stays between its bounds, halved by a count
                middle = (low + high) / 2
                if step % 2 and high - low > noise:
                    low, high = (middle, high) if over(middle) >= k else (low, middle)
                value = (low + high) / 2
        else:
            raise ArithmeticError(f"eigenvalue {k} did not converge")
        out.append((quotient, vector))
    values = [e for e, _ in out]
    for k, e in enumerate(values, 1):  # exactly those found at or above it lie above a shift just below it
        near = sum(f >= e - 2 * noise for f in values)
        if over(e - 2 * noise) < k or over(e + 2 * noise) > k - 1 or (near == k and k < rank and over(e - 2 * noise) != k):
            raise ArithmeticError(f"eigenvalue {k} is not certified by its counts")
    return [(e, v * math.copysign(1.0, v[np.abs(v).argmax()])) for e, v in out]


# Sums over all rows -------------------------------------------------------------------------

def _whole(b: pa.RecordBatch, d: int) -> np.ndarray:
    """The rows' whole numbers as n x d."""
    lists = b.column(b.num_columns - 1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    entries = np.zeros((b.num_rows, d))
    entries[np.arange(d) < sizes[:, None]] = flat
    x = np.floor(SCALE * entries) + OFFSET
    if x.size and np.abs(x).max() > LIMIT:
        raise ValueError(f"an entry's whole number exceeds {LIMIT} in size")
    return x.astype(np.int64)


def _summed(rows: DataFrame, d: int, of, width: int) -> list[int]:
    """Exact totals over all rows of ``of(batch)``, whole numbers n x ``width`` or their sums; element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            if b.num_rows:
                for part in of(_whole(b, d)):
                    if np.abs(total.astype(float)).max(initial=0) + np.abs(part.astype(float)).max(initial=0) > FAR:
                        yield sent(total)
                        total = np.zeros(width, np.int64)
                    total = total + part
        yield sent(total)

    def sent(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["at", "part"])

    sums = rows.select("embedding").mapInArrow(run, "at int, part long").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [0] * width
    for r in sums.collect():  # one row an element: the square of the dimension at most
        out[r["at"]] = int(r["total"])
    return out


def covariance(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The exact covariance (divisor n), rounded once to double."""
    middle = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def products(x: np.ndarray) -> Iterator[np.ndarray]:
        x = x - middle
        far = float(np.abs(x).max(initial=0)) ** 2
        step = max(1, min(len(x), int(FAR / 4 / max(far, 1.0))))
        for at in range(0, len(x), step):
            z = x[at : at + step]
            if far * step < 2.0**53:  # whole doubles, exact in any order
                z = z.astype(float)
            yield np.rint(z.T @ z).astype(np.int64).ravel() if z.dtype == float else (z.T @ z).ravel()

    total = _summed(rows, d, products, d * d)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    exact = [[float(Fraction(n * total[i * d + j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)]
    return np.array(exact).reshape(d, d)


def whiten(vectors: DataFrame, count: int = 8, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and leading component."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(storage.col(vec_col))).select(storage.col(id_col).alias("vec_id"), storage.col(vec_col).alias("embedding"))
    kind = rows.schema["vec_id"].dataType
    n, d, top = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))).cast("double")).first()
    d, top = d or 0, SCALE * (top or 0.0) + OFFSET + 1
    sums = _summed(rows, d, lambda x: [x[at : at + 1024].sum(0) for at in range(0, len(x), 1024)], d) if d else []
    v = covariance(rows, d, n, sums) if d else np.zeros((0, 0))
    parts = leading(v, count)
    if not parts:
        return spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double").select(F.lit(None).cast(kind).alias("vec_id"), "*")
    basis = np.stack([u / math.sqrt(e) for e, u in parts], 1)
    shares = [e / float(np.trace(v)) for e, _ in parts]
    k, exact_sums = len(parts), np.array(sums, object)
    fits = n * top < 2.0**62  # whole numbers of 64 bits hold n * x and S

    def projected(b: pa.RecordBatch) -> tuple[np.ndarray, list[int | None]]:
        x = _whole(b, d)
        far = x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - exact_sums
        about = (far.astype(float) ** 2).sum(1)
        # A sum below 2^63 is exact in 64-bit arithmetic, whatever wraps on the way.
        exact = (far * far).sum(1).tolist() if fits else [int(s) for s in (far * far).sum(1)]
        deviation = []
        for i, (total, rough) in enumerate(zip(exact, (about / 2.0**63).tolist())):
            if abs(rough - 1) < 1e-9:
                total = sum(int(c) ** 2 for c in far[i])
            deviation.append(total if rough < 1 + 1e-9 and 0 <= total < 2**63 else None)
        return (far.astype(float) / n) @ basis, deviation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, deviation = projected(b)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(b.num_rows * k, n, np.int64)), pa.array([x for x in deviation for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(shares, b.num_rows))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    def moments(center: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for b in batches:
                if b.num_rows:
                    w = projected(b)[0] - center
                    total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "part"])

        sums = rows.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()
        return np.array([r["total"] for r in sorted(sums, key=lambda r: r["at"])]) / n

    mean = moments(np.zeros(k))[:k]
    error = float(np.abs(moments(mean)[k:].reshape(k, k) - np.eye(k)).max())
    fields = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    return storage.spread(rows).mapInArrow(run, fields).withColumn("identity_error", F.lit(error))
