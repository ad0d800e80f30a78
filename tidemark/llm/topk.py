"""Exact top-k inner-product search over length buckets.

Vectors are grouped by length into buckets, and large buckets into blocks of about
``BLOCK`` rows. A first pass against one block of longest vectors gives every query
a lower bound on its k-th score. A block can hold a result only if
bound <= |q| * longest length in it. Queries are grouped by bound / |q|, the length
that they ask for, so whole pairs (block of queries, block of vectors) fall away
before anything is copied: vectors go only to the query blocks of which some query
may need them, and a query only to the blocks that it may need. Inside a block the
local cosine threshold bound / (|q| * longest) chooses, for each query, between length
pruning (a prefix of the vectors by length) and coordinate pruning (vectors whose
coordinate lies in the interval that the cosine threshold allows); the remaining
inner products are computed exactly.

Each pair of blocks returns at most k rows a query. The driver sees one row for each
of at most ``BUCKETS`` buckets and at most ``GROUPS`` group edges.

Defined results
- vectors null, or holding null or non-finite components, and rows without an id
  take no part
- components that one of two vectors lacks count as zero, so vectors of different
  sizes are compared over what they share
- repeated rows are separate candidates; rows with the query's own id are its own
- a repeated query id asks once, with its first vector in array order
- ties go to the smaller id; fewer than k candidates give fewer rows
- zero and empty vectors score 0; an empty table gives an empty result
- other columns are not read
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import storage

BUCKETS = 32
BLOCK = 16_384
QUERY_BLOCK = 8_192
GROUPS = 256  # of queries by the length that they ask for
FOCUS = 3
EPS = 1e-9


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantize(vec: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as whole doubles."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


class Block:
    """Vectors of one block, longest first, with each coordinate's sorted order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        length = np.sqrt((rows * rows).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        unit = self.rows / np.where(self.length > 0, self.length, 1)[:, None]
        self.by_coord = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.by_coord, axis=0)

    def candidates(self, q: np.ndarray, norm: float, bound: float) -> np.ndarray:
        """Rows that may reach ``bound``, by the pruning that leaves fewer."""
        n, longest = len(self.ids), self.length[0] if len(self.ids) else 0.0
        if bound <= 0 or norm == 0 or longest == 0:
            return np.arange(n)
        cosine = bound / (norm * longest) - EPS
        if cosine > 1:
            return np.arange(0)
        prefix = int(np.searchsorted(-self.length, -(bound / norm) * (1 - EPS), side="right"))
        unit = q / norm
        best = (prefix, -1, 0, 0)
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            c = min(1.0, max(0.0, cosine))
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - unit[f] ** 2)))
            # the interval of v_f over all cosines from c to 1 (it holds 1's own point, unit[f])
            low = -1.0 if -unit[f] >= c else unit[f] * c - spread
            high = 1.0 if unit[f] >= c else unit[f] * c + spread
            a, b = np.searchsorted(self.sorted[:, f], [low - EPS, high + EPS], side="left")
            if b - a < best[0]:
                best = (b - a, f, a, b)
        if best[1] < 0:
            return np.arange(prefix)
        cand = self.by_coord[best[2] : best[3], best[1]]
        return cand[cand < prefix]

    def search(self, query_id: int, whole: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.zeros(self.rows.shape[1])
        q[: len(whole)] = whole[: len(q)]
        cand = self.candidates(q, float(np.sqrt(whole @ whole)), bound)
        cand = cand[self.ids[cand] != query_id]
        scores = self.rows[cand] @ q
        if len(scores) and np.abs(self.rows[cand]).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) >= 2**53:
            scores = np.array([sum(int(x) * int(y) for x, y in zip(r, q)) for r in self.rows[cand]], dtype=object)
        if len(scores) > 4 * k and scores.dtype != object:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            cand, scores = cand[keep], scores[keep]
        order = sorted(range(len(cand)), key=lambda i: (-scores[i], self.ids[cand[i]]))[:k]
        return self.ids[cand[order]], np.array([int(scores[i]) for i in order], dtype=np.int64)


def _search_pair(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            rows = np.zeros((len(vectors), max(map(len, vectors["v"]))))
            for row, v in zip(rows, vectors["v"]):
                row[: len(v)] = v
            block = Block(vectors["vec_id"].to_numpy(np.int64), rows)
            for qid, q, bound in zip(queries["query_id"], queries["q"], queries["bound"]):
                ids, scores = block.search(qid, np.asarray(q, np.float64), bound, k)
                out.append(pd.DataFrame({"query_id": np.full(len(ids), qid), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    return run


def _pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows of both sides carry (block, qblock)."""
    keys = ("block", "qblock")
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search_pair(k), "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query, exactly."""
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    length2 = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    whole = clean.select("vec_id", "asks", quantize(F.col("e")).alias("v")).withColumn("n2", length2("v"))
    # Bounded numbers to the driver: bucket edges, then one count and one length for each bucket.
    edges = sorted(set(whole.agg(F.percentile_approx("n2", [i / BUCKETS for i in range(1, BUCKETS)], 10000)).first()[0] or []))
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("n2") > e, 1).otherwise(0)
    told = {r["bucket"]: r for r in whole.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("n2").alias("top"), F.sum(F.when(F.col("asks"), 1).otherwise(0)).alias("asked")).collect()}
    parts = {b: -(-r["n"] // BLOCK) for b, r in told.items()}
    spread = F.lit(1)
    for b, n in parts.items():
        spread = F.when(bucket == b, n).otherwise(spread)
    block = F.shiftleft(bucket.cast("long"), 32).bitwiseOR(F.pmod(F.xxhash64("vec_id", "v"), spread))
    placed = whole.select("vec_id", "v", block.alias("block"))
    if not told:
        return best(placed.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false"), k)

    queries = whole.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    qblocks = max(1, -(-sum(r["asked"] or 0 for r in told.values()) // QUERY_BLOCK))
    dealt = queries.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(qblocks)))
    probe = max(told, key=lambda b: (told[b]["top"], b)) << 32
    longest = placed.where(F.col("block") == probe).withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))))  # one block
    first = _pairs(longest, dealt.withColumns({"block": F.lit(probe), "bound": F.lit(float("-inf"))}), k)
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("bound"))
    bounded = storage.materialize(
        queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).withColumn("norm", F.sqrt(length2("q")))
        .withColumn("asks_for", F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm") * (1 - EPS)).otherwise(-1.0)), "queries")
    groups = min(qblocks, GROUPS)
    cuts = bounded.agg(F.percentile_approx("asks_for", [i / groups for i in range(1, groups)], 10000)).first()[0] if groups > 1 else []
    group = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("asks_for"))) if cuts else F.lit(0)
    grouped = bounded.withColumn("qblock", F.shiftleft(group.cast("long"), 32).bitwiseOR(F.pmod(F.xxhash64("query_id"), F.lit(-(-qblocks // groups)))))
    buckets = F.array(*[F.struct(F.lit(b).cast("long").alias("b"), F.lit(parts[b]).cast("long").alias("parts"), F.lit(float(r["top"]) ** 0.5).alias("top")) for b, r in told.items()])
    blocks = F.flatten(F.transform(F.filter(buckets, lambda b: F.col("asks_for") <= b["top"] * (1 + EPS) + EPS), lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["parts"] - 1), lambda i: F.shiftleft(b["b"], 32).bitwiseOR(i))))
    needed = grouped.groupBy("qblock").agg(F.min("asks_for").alias("asks_for")).select((F.col("qblock") + 0).alias("qblock"), F.explode(blocks).alias("block"))
    return best(_pairs(placed.join(needed, "block"), grouped.select("query_id", "q", "qblock", "bound", F.explode(blocks).alias("block")), k), k)
