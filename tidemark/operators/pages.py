"""Stored row order: a table in files of consecutive rows, with an index of their offsets.

``store`` sorts a table once, by range partitions whose bounds are quantiles of the
whole order key, so equal first values spread over files too. The index has one row for
each file: its first and last key, its rows, and the number of rows before it. A page, or
the rows between two keys, then reads only the files that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.select import ORDER

FILE = "_metadata.file_path"


def store(df: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """Write ``df`` in ``order`` (nulls first) at ``path``, about ``files`` files, with its index.

    The order should be total; rows with equal keys are stored in any order, once.
    """
    order = order or ORDER
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    key = F.struct(*order)
    each = stored.groupBy(F.col(FILE).alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1))
    each.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/index")  # a row a file


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last (key structs), rows, base (rows before the file)."""
    return spark.read.parquet(f"{path}/index")


def _of_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    every = spark.read.parquet(f"{path}/rows")
    return spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)


def page(spark: SparkSession, path: str, offset: int, max_rows: int, name: str = "row_number") -> DataFrame:
    """Rows [offset, offset + max_rows) in the stored order with their 1-based number; other files are not read."""
    known = index(spark, path)
    order = known.schema["first"].dataType.fieldNames()
    hit = known.where((F.col("base") < offset + max_rows) & (F.col("base") + F.col("rows") > offset)).select("file", "base").collect()  # a page's files
    rows = _of_files(spark, path, [r["file"] for r in hit])
    bases = F.create_map(*[F.lit(x) for r in hit for x in (r["file"], r["base"])]) if hit else F.create_map().cast("map<string,bigint>")
    inside = F.row_number().over(Window.partitionBy(F.col(FILE)).orderBy(*order))
    numbered = rows.withColumn(name, (F.try_element_at(bases, F.col(FILE)) + inside).cast("long"))
    return numbered.where((F.col(name) > offset) & (F.col(name) <= offset + max_rows))


def between(spark: SparkSession, path: str, first, last) -> DataFrame:
    """Rows whose first order column lies in [first, last], from the files that may hold them."""
    known = index(spark, path)
    column = known.schema["first"].dataType.fieldNames()[0]
    hit = known.where((F.col(f"first.{column}") <= F.lit(last)) & (F.col(f"last.{column}") >= F.lit(first))).select("file").collect()
    return _of_files(spark, path, [r["file"] for r in hit]).where(F.col(column).between(F.lit(first), F.lit(last)))


def numbered(spark: SparkSession, path: str, name: str = "row_number") -> DataFrame:
    """All stored rows with their 1-based number; one window for each file."""
    base = f"{name}_base"
    known = index(spark, path).select(F.col("file").alias(f"{name}_file"), F.col("base").alias(base))
    order = index(spark, path).schema["first"].dataType.fieldNames()
    inside = F.row_number().over(Window.partitionBy(f"{name}_file").orderBy(*order))
    rows = spark.read.parquet(f"{path}/rows").withColumn(f"{name}_file", F.col(FILE))
    return rows.withColumn(name, inside).join(known, f"{name}_file").withColumn(name, (F.col(base) + F.col(name)).cast("long")).drop(base, f"{name}_file")
