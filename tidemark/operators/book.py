"""Order books: depth arrays, level-2 and level-3 replay, snapshot views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import running

PAIR = ("exchange", "symbol")


def _toward_spread(side: str = "side"):
    return F.when(F.col(side) == "bid", -F.col("price")).otherwise(F.col("price"))


def top_levels(levels: DataFrame, depth: int | None, *keys: str) -> DataFrame:
    """The best ``depth`` levels of each book and side with their rank; depth 0 or None keeps all."""
    ranked = levels.withColumn("level", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(_toward_spread())))
    return ranked.where(F.col("level") <= depth) if depth else ranked


def book_arrays(levels: DataFrame, depth: int | None, *keys: str) -> DataFrame:
    """bids, asks as [[prices], [volumes]]: bids descending, asks ascending; an absent side is two empty rows."""
    top = top_levels(levels, depth, *keys)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("level", "price", "amount"))))
    two = lambda c: F.array(F.transform(c, lambda x: x["price"]), F.transform(c, lambda x: x["amount"]))
    return top.groupBy(*keys).agg(side("bid").alias("b"), side("ask").alias("a")).select(*keys, two(F.col("b")).alias("bids"), two(F.col("a")).alias("asks"))


def cut_depth(books: DataFrame, depth: int | None) -> DataFrame:
    """Snapshots cut to their first ``depth`` levels."""
    if not depth:
        return books
    cut = lambda m: F.transform(m, lambda r: F.slice(r, 1, depth))
    return books.withColumns({"bids": cut(F.col("bids")), "asks": cut(F.col("asks"))})


def level_intervals(changes: DataFrame, *keys: str) -> DataFrame:
    """Live levels as [valid_from, valid_to); valid_to is null while a level stands. Negative amounts are ignored.

    Windows partition by price as well, so one busy pair spreads over its prices.
    """
    w = Window.partitionBy(*keys, "side", "price").orderBy("timestamp", "event_id")
    return changes.where("amount >= 0").select(*keys, "side", "price", "amount", F.col("timestamp").alias("valid_from"), F.lead("timestamp").over(w).alias("valid_to")).where("amount > 0")


def on_grid(intervals: DataFrame, every: str, until=None) -> DataFrame:
    """Levels alive at each multiple of ``every`` up to ``until`` (default: the last change)."""
    step = S.duration_micros(every)
    if until is None:
        until = intervals.agg(F.max(S.epoch_micros(F.greatest("valid_from", F.coalesce("valid_to", "valid_from"))))).first()[0] or 0
    start = F.ceil(S.epoch_micros(F.col("valid_from")) / step).cast("long") * step
    end = F.least(F.coalesce(S.epoch_micros(F.col("valid_to")) - 1, F.lit(until)), F.lit(until))
    return intervals.where(start <= end).withColumn("grid", F.explode(F.sequence(start, end, F.lit(step)))).withColumn("ts", S.from_micros(F.col("grid"))).drop("grid", "valid_from", "valid_to")


def replay(changes: DataFrame, every: str, depth: int | None = 20, until=None) -> DataFrame:
    """Top levels of every pair's book on a time grid, one row a level."""
    return top_levels(on_grid(level_intervals(changes, *PAIR), every, until), depth, "ts", *PAIR)


def replay_with_snapshots(changes: DataFrame, snapshots: DataFrame, every: str, depth: int | None = 20, until=None) -> DataFrame:
    """As ``replay``, where a snapshot (exchange, symbol, event_id, timestamp, side, price, amount) replaces the pair's book."""
    starts = snapshots.select(*PAIR, "event_id", "timestamp").distinct()
    w = Window.partitionBy(*PAIR).orderBy("event_id")
    epochs = starts.select(*PAIR, F.col("event_id").alias("from_id"), F.lead("event_id").over(w).alias("to_id"), F.lead("timestamp").over(w).alias("closes"))
    marks = starts.select(*PAIR, "event_id", F.lit(1).alias("mark"))
    rows = changes.join(marks, [*PAIR, "event_id"], "left_anti").select(*PAIR, "event_id", "timestamp", "side", "price", "amount").unionByName(snapshots.select(*PAIR, "event_id", "timestamp", "side", "price", "amount"))
    marked = rows.join(marks.distinct(), [*PAIR, "event_id"], "left")
    dated = running.running_max(marked, PAIR, ("event_id",), {"from_id": F.when(F.col("mark") == 1, F.col("event_id"))}, inclusive=True).where("from_id is not null").drop("mark")
    live = level_intervals(dated, *PAIR, "from_id").join(epochs, [*PAIR, "from_id"])
    closed = live.withColumn("valid_to", F.least("valid_to", "closes")).drop("closes", "to_id")
    return top_levels(on_grid(closed, every, until), depth, "ts", *PAIR).drop("from_id")


def order_transitions(events: DataFrame) -> DataFrame:
    """order_id, sequence, type, price, remaining: every step of a known order's life.

    Windows only: ``life`` counts opens of an order, ``ep`` counts its resets of size
    inside a life; what is left is the reset size less the matches since.
    """
    by = lambda *k: Window.partitionBy(*k).orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("order_id", "life").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    lives = events.withColumn("life", F.sum(F.when(F.col("type") == "open", 1).otherwise(0)).over(by("order_id"))).where("life > 0")
    eps = lives.withColumns({"ep": F.sum(F.when(F.col("type").isin("open", "change"), 1).otherwise(0)).over(by("order_id", "life")),
                             "standing": F.first("price").over(by("order_id", "life"))})
    left = F.first("size").over(by("order_id", "life", "ep")) - F.sum(F.when(F.col("type") == "match", F.col("size")).otherwise(0)).over(by("order_id", "life", "ep"))
    steps = eps.withColumn("left", left).withColumn("ends", (F.col("type") == "done") | ((F.col("type") == "match") & (F.col("left") <= 0)))
    alive = steps.withColumn("ended", F.coalesce(F.max("ends").over(before), F.lit(False))).where("not ended")
    # a finished market order names no price: the life ends and its level stays
    remaining = F.when(F.col("ends") & ~((F.col("type") == "done") & F.col("price").isNull()), 0).otherwise(F.col("left"))
    return alive.select("order_id", "sequence", "type", F.col("standing").alias("price"), remaining.cast("long").alias("remaining"))


def rejected_matches(events: DataFrame) -> DataFrame:
    """Matches whose maker is not a living order."""
    known = order_transitions(events).select("order_id", "sequence")
    return events.where("type = 'match'").join(known, ["order_id", "sequence"], "left_anti")


def levels_from_orders(transitions: DataFrame) -> DataFrame:
    """price, orders, amount at the end: level 2 from level 3."""
    last = transitions.groupBy("order_id").agg(F.max_by(F.struct("price", "remaining"), "sequence").alias("l"))
    return last.where("l.remaining > 0").groupBy("l.price").agg(F.count("*").alias("orders"), F.sum("l.remaining").alias("amount"))


def load_orders(snapshot: DataFrame, events: DataFrame, base_sequence: int) -> DataFrame:
    """Initial orders (order_id, price, size) as opens at the base sequence, then later events only."""
    opens = snapshot.select(F.lit(base_sequence).cast("long").alias("sequence"), "order_id", F.lit("open").alias("type"), "price", "size")
    return opens.unionByName(events.where(F.col("sequence") > base_sequence).select("sequence", "order_id", "type", "price", "size"))


def top_view(books: DataFrame, n: int = 3) -> DataFrame:
    """First n prices and volumes of each side, and how many levels each has."""
    part = lambda side, r: F.slice(F.get(F.col(side), r), 1, n)
    rest = [c for c in books.columns if c not in ("bids", "asks")]
    return books.select(*rest, *[part(s, r).alias(f"{s[:-1]}_{name}") for s in ("bids", "asks") for r, name in enumerate(("prices", "volumes"))], *[F.size(F.get(F.col(s), F.lit(0))).alias(f"{s[:-1]}_levels") for s in ("bids", "asks")])


def flatten(books: DataFrame, depth: int = 10) -> DataFrame:
    """bid_0_price, bid_0_size, … one column for each level; null beyond a book's depth."""
    rest = [c for c in books.columns if c not in ("bids", "asks")]
    cells = [F.try_element_at(F.get(F.col(f"{side}s"), F.lit(r)), F.lit(i + 1)).alias(f"{side}_{i}_{name}") for side in ("bid", "ask") for i in range(depth) for r, name in enumerate(("price", "size"))]
    return books.select(*rest, *cells)


def thin(books: DataFrame, interval: int, *keys: str) -> DataFrame:
    """Every ``interval``-th snapshot of each pair; a busy pair is numbered in chunks."""
    n, chunk = S.free(books, "n")[0], S.duration_micros("10m")
    return running.numbered(books, keys or PAIR, ("timestamp", "event_id"), n, chunk).where(F.col(n) % interval == 0).drop(n)
