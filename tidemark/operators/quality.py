"""Data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_problems(df: DataFrame, expected: T.StructType) -> list[str]:
    """What keeps ``df`` from having the expected columns and types; empty if nothing does."""
    have = {f.name: f.dataType for f in df.schema}
    out = [f"missing column {f.name}" for f in expected if f.name not in have]
    return out + [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in expected if f.name in have and have[f.name].simpleString() != f.dataType.simpleString()]


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    if problems := schema_problems(df, expected):
        raise ValueError("; ".join(problems))
    return df


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])


def shape_violations(books: DataFrame, depth: int) -> DataFrame:
    """Books whose sides lack two rows of equal length, or are deeper than ``depth``."""
    bad = lambda s: F.coalesce((F.size(s) != 2) | (F.size(F.get(F.col(s), F.lit(0))) != F.size(F.get(F.col(s), F.lit(1)))), F.lit(True))
    deep = F.greatest(F.size(F.get(F.col("bids"), F.lit(0))), F.size(F.get(F.col("asks"), F.lit(0)))) > depth
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return books.agg(F.count("*").alias("books"), n(bad("bids")).alias("bad_bids"), n(bad("asks")).alias("bad_asks"), n(deep).alias("too_deep"))


def order_violations(books: DataFrame) -> DataFrame:
    """Books with bids not descending, asks not ascending, or crossed."""
    prices = lambda s: F.get(F.col(s), F.lit(0))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return books.agg(
        n(prices("bids") != F.sort_array(prices("bids"), asc=False)).alias("bids_unsorted"), n(prices("asks") != F.sort_array(prices("asks"))).alias("asks_unsorted"),
        n(F.get(prices("bids"), F.lit(0)) >= F.get(prices("asks"), F.lit(0))).alias("crossed"))


def completeness(ledger: DataFrame, table: DataFrame, least: float = 0.9) -> DataFrame:
    """Rows the ledger promises against rows the table has."""
    promised = ledger.agg(F.sum("row_count").alias("written")).select(F.lit(1).alias("k"), "written")
    there = table.agg(F.count("*").alias("found")).select(F.lit(1).alias("k"), "found")
    ratio = F.try_divide(F.col("found").cast("double"), F.col("written").cast("double"))
    return promised.join(there, "k").select("written", "found", F.round(ratio, 4).alias("ratio"), (F.col("found") >= least * F.col("written")).alias("complete"))
