"""Tables that a stream keeps up to date: newest rows, standing levels, candles, progress.

Each is replaced as a whole or by partition under the id of its micro-batch, so a
repeated batch replaces what its first try left, and readers see a finished version.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.functions import scalar as S
from tidemark.operators import sample, select


class Versions:
    """Complete tables under ``path``, one folder for each micro-batch that changed them."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def finished(self) -> list[int]:
        """The batch ids whose tables are complete."""
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in names if fs.exists(child(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest complete table, or the newest one older than batch ``before``."""
        known = [v for v in self.finished() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={known[-1]:012d}") if known else None

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch_id:012d}")
        root, fs = self._fs()
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in self.finished()[: -self.keep]:
            fs.delete(child(root, f"v={old:012d}"), True)


def _each_batch(df: DataFrame, checkpoint: str, one: Callable[[DataFrame, int], None]) -> StreamingQuery:
    query = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    return query


def keep_last(df: DataFrame, n: int, path: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Keep the last ``n`` rows of a stream in ``order`` at ``path``; read them with ``Versions``.

    A batch costs a top-n of its own rows and of the n kept ones, whatever came before.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        table = Versions(batch.sparkSession, path)
        stored = table.read(batch_id)
        rows = batch if stored is None else stored.select(*batch.columns).unionByName(batch)
        table.write(select.last_rows(rows, n, *order), batch_id)

    return _each_batch(df, checkpoint, one)


def keep_levels(levels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the standing levels of ``keyed.book_levels`` at ``path``: one table, deleted levels gone."""
    key = ("exchange", "symbol", "side", "price")

    def one(batch: DataFrame, batch_id: int) -> None:
        table = Versions(batch.sparkSession, path)
        stored = table.read(batch_id)
        rows = batch if stored is None else stored.unionByName(batch)
        newest = sample.latest(rows, *key, order=F.struct("micros", "event_id"))
        table.write(newest.where("amount > 0").select(*batch.columns), batch_id)

    return _each_batch(levels, checkpoint, one)


def keep_candles(trades: DataFrame, every: str, rows: str, candles: str, checkpoint: str, part: str = "1h") -> StreamingQuery:
    """Keep exact candles at ``candles``, rows that come late included.

    Rows are stored at ``rows`` by span of ``part`` and batch; every span that a batch
    touches, old ones too, is computed again from its stored rows and put in place
    alone. ``every`` must divide ``part``. A repeated batch replaces its own files.
    """
    width = S.duration_micros(part)
    if width % S.duration_micros(every):
        raise ValueError(f"{every} does not divide {part}")
    span = F.floor(S.epoch_micros(F.col("timestamp")) / width)

    def put(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put(batch.withColumns({"span": span, "txn_id": F.lit(batch_id)}), rows, "span", "txn_id")
        stored = spark.read.schema(T.StructType([*batch.schema, T.StructField("span", T.LongType()), T.StructField("txn_id", T.LongType())])).parquet(rows)
        touched = [r["span"] for r in stored.where(F.col("txn_id") == batch_id).select("span").distinct().collect()]  # spans of one batch
        if touched:
            again = stored.where(F.col("span").isin(touched)).drop("span", "txn_id")
            made = sample.candles(again, every)
            put(made.withColumn("span", F.floor(S.epoch_micros(F.col("ts").cast("timestamp_ntz")) / width)), candles, "span")

    return _each_batch(trades, checkpoint, one)


def ingest(df: DataFrame, table: str, ledger: str, checkpoint: str, ts: str = "timestamp", trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to ``table`` and one ledger row for each micro-batch to ``ledger``.

    The ledger row is observed while the batch is written: nothing is read twice. Both are
    written under the batch id, so a repeated batch replaces itself.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch-{batch_id}")
        watched = batch.observe(seen, F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
        watched.write.mode("overwrite").parquet(f"{table}/txn_id={batch_id}")
        of, kind = seen.get, batch.schema[ts].dataType
        schema = T.StructType([T.StructField("txn_id", T.LongType()), T.StructField("row_count", T.LongType()), T.StructField("min_ts", kind), T.StructField("max_ts", kind)])
        row = batch.sparkSession.createDataFrame([(batch_id, of["row_count"], of["min_ts"], of["max_ts"])], schema)
        row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(one).start()


class ProgressTable(StreamingQueryListener):
    """Writes batch id, rows in, old and new size of every update of one query to ``path``.

    Add it with ``spark.streams.addListener`` before the query starts. Updates that Spark
    no longer keeps in ``recentProgress`` stay in the table. ``resume`` sizes go on from
    what an earlier run wrote there. A query is chosen by its name.
    """

    SCHEMA = "batch_id long, rows_in long, old_size long, new_size long"

    def __init__(self, spark: SparkSession, path: str, query_name: str) -> None:
        self.spark, self.path, self.name = spark, path.rstrip("/"), query_name
        self.size, self.id, self.ended = 0, None, threading.Event()
        _, fs = Versions(spark, path)._fs()
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            self.size = self.read().agg(F.max("new_size")).first()[0] or 0

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.id = event.id
            self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or not p.numInputRows:
            return
        row = (p.batchId, p.numInputRows, self.size, self.size + p.numInputRows)
        self.size = row[3]
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/update={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self.id:
            self.ended.set()

    def finish(self, seconds: float = 60) -> None:
        """Wait until the query's last update is written."""
        if not self.ended.wait(seconds):
            raise TimeoutError(f"{self.name} has not ended")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).drop("update")
