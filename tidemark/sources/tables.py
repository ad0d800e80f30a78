"""Scans, sinks, table definitions, retention and catalog listings."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import scalar as S


def run_query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """SQL text over named DataFrames."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """``trades`` by day and ``orderbooks`` by day and hour, if absent."""
    columns = lambda schema: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.trades ({columns(schemas.TRADES)}, dt DATE) USING parquet PARTITIONED BY (dt)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.orderbooks ({columns(schemas.ORDERBOOKS)}, dt DATE, hour INT) USING parquet PARTITIONED BY (dt, hour)")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    spark.sql(f"DROP VIEW IF EXISTS {database}.orderbooks_1s")
    for name in ("trades", "orderbooks"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def describe(spark: SparkSession, database: str = "default") -> DataFrame:
    """table, position (from 0), column, type of every table in the database."""
    rows = [(t.name, i, c.name, c.dataType) for t in spark.catalog.listTables(database) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def with_partitions(df: DataFrame, hourly: bool = False) -> DataFrame:
    out = df.withColumn("dt", F.to_date("timestamp"))
    return out.withColumn("hour", F.hour("timestamp")) if hourly else out


def append_trades(df: DataFrame, path: str) -> None:
    with_partitions(df.select(*schemas.TRADES.fieldNames())).write.mode("append").partitionBy("dt").parquet(path)


def by_time(df: DataFrame, rows: int, *ties: str, size: int = 100_000) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by spans of time of about ``size`` rows; ``ties`` part rows of one moment."""
    return df.repartitionByRange(max(1, -(-rows // size)), "timestamp", *ties)


def append_books(df: DataFrame, path: str, dealt: bool = False) -> None:
    """Append books by day and hour.

    ``dealt``: the rows lie by time already, as ``by_time`` deals them; an hour then has as
    many files as spans. It costs least before the 20 levels are made. Other rows are
    dealt here, as whole books.
    """
    books = with_partitions(df.select(*schemas.ORDERBOOKS.fieldNames()), hourly=True)
    (books if dealt else books.repartition("dt", "hour", F.minute("timestamp"))).write.mode("append").partitionBy("dt", "hour").parquet(path)


def read_between(spark: SparkSession, path: str, schema: T.StructType, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows with start <= timestamp < end; the day predicate prunes partitions."""
    df = spark.read.parquet(path)
    days = (F.col("dt") >= F.lit(start.date())) & (F.col("dt") <= F.lit(end.date()))
    return df.where(days & (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))).select(*schema.fieldNames())


def retain(df: DataFrame, keep: str, as_of: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows newer than ``keep`` before ``as_of`` (default: the newest row)."""
    if as_of is None:
        newest = df.agg(F.max(ts)).first()[0]
        if newest is None:
            return df
        as_of = F.lit(newest).cast("timestamp_ntz")
    return df.where(F.col(ts) > as_of - F.expr(f"interval {S.duration(keep)}"))


CUT = "_cut-"  # folders of hours that are being cut; readers of the table skip such names (without a "=")


class _Cut:
    """Replacement of one hour's files by its kept rows, in steps that can each be repeated.

    The kept rows are written aside, a marker then names the old files, the old files go,
    the new ones move in, and the aside folder goes. Until the marker stands nothing has
    happened to the hour; from then on ``finish`` completes the rest, however often a run
    stops in between, and no row is ever seen twice.
    """

    def __init__(self, spark: SparkSession, path: str, hour: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.hour = self._path(path, hour)  # dt=.../hour=...
        self.aside = self._path(path, CUT + hour.replace("/", "+").replace("=", "~"))
        self.fs = self.hour.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def prepare(self, cut: dt.datetime) -> None:
        """Write the kept rows aside and mark the files that they replace."""
        self.fs.delete(self.aside, True)
        old = [f.getPath() for f in self.fs.listStatus(self.hour)]
        rows = self.spark.read.parquet(*[f.toString() for f in old if not f.getName().startswith("_")])
        rows.where(F.col("timestamp") > F.lit(cut).cast("timestamp_ntz")).write.parquet(f"{self.aside}/kept")
        draft = self._path(f"{self.aside}", "draft")
        out = self.fs.create(draft, True)
        out.write(bytearray("\n".join(f.getName() for f in old).encode()))
        out.close()
        self.fs.rename(draft, self._path(f"{self.aside}", "marker"))

    def finish(self) -> None:
        """Complete a marked replacement, or drop what was not marked."""
        marker = self._path(f"{self.aside}", "marker")
        if self.fs.exists(marker):
            stream = self.fs.open(marker)
            names = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            stream.close()
            for name in names:
                self.fs.delete(self._path(f"{self.hour}", name), False)
            for f in self.fs.listStatus(self._path(f"{self.aside}", "kept")):
                if not f.getPath().getName().startswith("_"):
                    self.fs.rename(f.getPath(), self._path(f"{self.hour}", f.getPath().getName()))
        self.fs.delete(self.aside, True)


def drop_expired_hours(spark: SparkSession, path: str, keep: str, as_of: dt.datetime) -> int:
    """Delete the hours that ``keep`` before ``as_of`` leaves behind; the number of folders deleted.

    Whole expired hours are deleted as folders. The hour that the cut falls into is replaced
    by its kept rows; what an earlier, interrupted run left is completed first. Files that
    others add meanwhile stay.
    """
    path = path.rstrip("/")
    cut = as_of - dt.timedelta(microseconds=S.duration_micros(keep))
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{CUT}*")):
        _Cut(spark, path, left.getPath().getName().removeprefix(CUT).replace("+", "/").replace("~", "=")).finish()

    def drop(day) -> tuple[int, list[str]]:
        """Hours of a day that were deleted, and the one that the cut falls into."""
        gone, split, date = 0, [], dt.date.fromisoformat(day.getName()[3:])
        for hour in fs.listStatus(day) if date <= cut.date() else ():
            of = hour.getPath().getName().removeprefix("hour=")
            if not of.isdigit() or (date == cut.date() and int(of) > cut.hour):
                continue
            if (date, int(of)) == (cut.date(), cut.hour):
                split.append(f"{day.getName()}/{hour.getPath().getName()}")
            else:
                fs.delete(hour.getPath(), True)
                gone += 1
        return gone, split

    days = [day.getPath() for day in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "dt=*"))]
    with ThreadPoolExecutor(16) as pool:  # each folder waits for the file system
        done = [*pool.map(drop, days)]
    for hour in (h for _, split in done for h in split):
        replaced = _Cut(spark, path, hour)
        replaced.prepare(cut)
        replaced.finish()
    return sum(gone for gone, _ in done)


def export(df: DataFrame, limit: int):
    """At most ``limit`` rows as an Arrow table for a client."""
    return df.limit(limit).toArrow()
