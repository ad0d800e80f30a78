"""Shared-folder helpers: every intermediate table lives where all executors see it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCOPE: ContextVar[list[str] | None] = ContextVar("tables", default=None)  # paths made in the present scope
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only in local mode (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the table is written: its shuffle files are not needed again
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before or "false")
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def drop(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` once nothing reads it any more."""
    delete(table.sparkSession, table.tidemark_path)
    made = _SCOPE.get()
    if made and table.tidemark_path in made:
        made.remove(table.tidemark_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at the end, but for those given to ``keep``; others are never touched.

    Results that still read them must be written by then. A thread has its own scope.
    """
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in made:
            delete(spark, path)


def keep(table: DataFrame) -> DataFrame:
    """Let a table made by ``materialize`` outlive the present scope."""
    made = _SCOPE.get()
    if made and table.tidemark_path in made:
        made.remove(table.tidemark_path)
    return table


HOT = 1_000  # keys that hold over 1 / HOT of all rows: at most so many


def join_counted(rows: DataFrame, told: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined to ``told``, which has each key once with its number of rows ``n``.

    Keys that hold more than 1 / ``HOT`` of all rows are looked up in a broadcast table of
    at most ``HOT`` rows, so that no task gets all rows of one; the others are shuffled.
    ``n`` is dropped; null keys do not join.
    """
    total = told.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT, total / HOT)
    few = told.where(hot)
    if few.isEmpty():
        return rows.join(told.drop(n), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(told.where(~hot).drop(n), key)
    return rows.join(F.broadcast(few.drop(n)), key).unionByName(rest)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where a small scan has fewer partitions than there are cores."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


ROWS = 500  # rows of a batch that a task works on at once


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``ROWS`` rows.

    A batch can be a whole partition, so what is made of it in one piece fills the Python
    worker, and once more the JVM that reads it. Workers outlive their tasks: memory that
    Arrow kept of earlier ones is given back first.
    """
    pa.default_memory_pool().release_unused()
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name; ``run`` sees and gives the real names, in ``parts``."""
    real, made = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pa.RecordBatch.from_arrays(b.columns, names=real) for b in parts(batches)):
            yield pa.RecordBatch.from_arrays(b.columns, names=made)

    plain = T.StructType([T.StructField(m, f.dataType) for m, f in zip(made, schema)])
    return df.toDF(*[f"c{i}" for i in range(len(real))]).mapInArrow(renamed, plain).toDF(*schema.names)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
