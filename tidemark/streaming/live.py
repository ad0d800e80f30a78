"""Live tables, ingest ledger, streaming views and keyed book state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import running, sample


def live_table(spark: SparkSession, path: str, schema: T.StructType, refreshing: bool = True, max_files: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream over a growing folder (its files that match ``pattern``), or a static scan of it."""
    if not refreshing:
        return spark.read.schema(schema).parquet(path)
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def zoned(df: DataFrame, ts: str = "timestamp", delay: str = "10 seconds") -> DataFrame:
    """Event time as a zoned timestamp under a watermark (streams need one)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def candles(trades: DataFrame, every: str, delay: str = "10 seconds") -> DataFrame:
    """Streaming candles: append mode emits closed buckets, update mode running ones."""
    return sample.candles(zoned(trades, delay=delay), every)


def sampled_books(books: DataFrame, every: str = "1s", delay: str = "10 seconds") -> DataFrame:
    """The maintained view of last snapshots for each bucket."""
    return sample.sample_books(zoned(books, delay=delay), every)


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """Streaming latest row of each key (update or complete mode)."""
    return sample.latest(df, *keys)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop.

    Append goes to Parquet. Complete mode keeps the newest result. Update mode keeps
    every micro-batch under its id, which a repeated batch replaces; ``newest`` reads
    the newest row of each key.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    else:
        query = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
    query.awaitTermination()
    return query


def newest(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key among the micro-batches that update mode wrote."""
    return sample.latest(updates, *keys, order=F.col("batch")).drop("batch")


def changes_since(ledger: DataFrame, txn: int) -> DataFrame:
    return ledger.where(F.col("txn_id") > txn).orderBy("txn_id")


def table_size(ledger: DataFrame, table: DataFrame) -> DataFrame:
    """Rows by the ledger, or by counting where the ledger has no count."""
    by_log = ledger.agg(F.sum("row_count").alias("logged")).select(F.lit(1).alias("k"), "logged")
    counted = table.agg(F.count("*").alias("n")).select(F.lit(1).alias("k"), "n")
    return by_log.join(counted, "k").select(F.coalesce("logged", "n").alias("rows"))


def newest_with_total(ledger: DataFrame) -> DataFrame:
    """The newest transaction beside the total of all row counts."""
    return ledger.agg(F.max("txn_id").alias("txn_id"), F.max_by("row_count", "txn_id").alias("row_count"), F.sum("row_count").alias("total_rows"))


def incremental_size(ledger: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Table size after each transaction (the ledger has one row a transaction; missing counts add none)."""
    return running.running_sum(ledger.select("txn_id", "row_count"), (), ("txn_id",), F.col("row_count"), "table_rows", chunk).select("txn_id", "table_rows")


def size_steps(ledger: DataFrame) -> DataFrame:
    """txn_id, old_size, new_size: the progress report of each transaction."""
    after = running.running_sum(ledger.select("txn_id", "row_count"), (), ("txn_id",), F.col("row_count"), "new_size", 100_000)
    return after.select("txn_id", (F.col("new_size") - F.coalesce("row_count", F.lit(0))).alias("old_size"), "new_size")


def next_size(ledger: DataFrame, last_txn: int, last_size: int, recount: Callable[[], int]) -> int:
    """Size after the transactions beyond ``last_txn``; recounts if none of them has a count."""
    row = ledger.where(F.col("txn_id") > last_txn).agg(F.sum("row_count").alias("s"), F.count("*").alias("n")).first()
    if row["n"] == 0:
        return last_size
    return last_size + row["s"] if row["s"] is not None else recount()


def growth(df: DataFrame, first, second, ts: str = "timestamp") -> DataFrame:
    """Rows up to two moments, their difference, and whether data flows."""
    n = lambda t: F.sum(F.when(F.col(ts) <= t, 1).otherwise(0)).cast("long")
    return df.agg(n(first).alias("before"), n(second).alias("after")).select("before", "after", (F.col("after") - F.col("before")).alias("delta"), F.when(F.col("after") > F.col("before"), "flowing").otherwise("stale").alias("status"))


def deduplicated(df: DataFrame, keys: list[str], delay: str = "10 seconds") -> DataFrame:
    return zoned(df, delay=delay).dropDuplicatesWithinWatermark(keys)


def stop_all(spark: SparkSession) -> None:
    for q in spark.streams.active:
        q.stop()


def progress(query: StreamingQuery) -> list[tuple[int, int, int, int]]:
    """(batch id, rows in, old size, new size) of the recent updates, counted from the first of them.

    Spark keeps about 100 updates; ``kept.ProgressTable`` writes every one.
    """
    out, size = [], 0
    for p in query.recentProgress:
        out.append((p["batchId"], p["numInputRows"], size, size + p["numInputRows"]))
        size += p["numInputRows"]
    return out


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, over the recent updates.

    ``kept.keep_candles`` puts such rows in place instead.
    """
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def book_state(changes: DataFrame) -> DataFrame:
    """Streaming book: the newest change of each level of each pair (update mode).

    A change of amount 0 deletes the level, above 0 sets it, below 0 is ignored. State
    is keyed by level, so a busy pair spreads, and the newest (timestamp, event_id) wins
    in whatever order and batch the rows come; ``standing`` reads the book.
    """
    order = F.struct("timestamp", "event_id")
    return changes.where("amount >= 0").groupBy("exchange", "symbol", "side", "price").agg(F.max_by("amount", order).alias("amount"))


def standing(updates: DataFrame) -> DataFrame:
    """The levels that stand after all micro-batches of ``book_state``."""
    return newest(updates, "exchange", "symbol", "side", "price").where("amount > 0")
