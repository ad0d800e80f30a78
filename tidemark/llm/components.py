"""Connected components: in memory for one task's rows, and over a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage


HUB = 1_000  # greater neighbours beyond which a node is a hub, or more where the table is large
HUBS = 100_000


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k]; ``label`` holds each node's smallest known member."""
    while len(i):
        li, lj = label[i], label[j]
        while True:  # up to the roots
            ni, nj = label[li], label[lj]
            if (ni == li).all() and (nj == lj).all():
                break
            li, lj = ni, nj
        differ = li != lj
        if not differ.any():
            break
        i, j = np.minimum(li, lj)[differ], np.maximum(li, lj)[differ]
        np.minimum.at(label, j, i)
    while True:
        up = label[label]
        if (up == label).all():
            return
        label[:] = up


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _star(now: DataFrame, edges: int) -> DataFrame:
    """The large-star step: each node's greater neighbours link to its least neighbour or itself.

    Nodes with many greater neighbours look their least one up in a broadcast table of
    at most ``HUBS`` rows, so a hub's star does not meet in one task.
    """
    low = now.groupBy("a").agg(F.min("b").alias("m"))
    up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
    many = up.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > max(HUB, edges // HUBS)).select("a")
    hubs = many.join(low, "a", "left").select("a", F.coalesce("m", "a").alias("m"))
    of_hubs = up.join(F.broadcast(hubs), "a")
    others = up.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low, "a", "left").select("a", "b", F.coalesce("m", "a").alias("m"))
    return of_hubs.select("a", "b", "m").unionByName(others).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node) for every node of ``edges`` (a, b: long).

    Alternates large-star and small-star steps, each a min per node and a join,
    until the edge table is a set of stars. Every round is written to the shared
    folder, so lineage stays short and a lost executor costs one round.
    """
    now = storage.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while True:
        large = _star(now, before[0])
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        after = storage.materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        storage.drop(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
