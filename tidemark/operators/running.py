"""Running values over long ordered histories, cut into chunks so that one busy key spreads.

Windows stay inside a chunk of the order; what came before is carried from one row
for each chunk. Keys may be null; without keys the whole table is one history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S

CHUNK = 1_000_000  # numbers, or microseconds, of the first order column in a chunk


def position(df: DataFrame, order: str) -> Column:
    """A number that grows with ``order``: the column itself, or its microseconds."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return S.epoch_micros(F.col(order).cast("timestamp_ntz"))
    if isinstance(kind, T.NumericType):
        return F.col(order)
    raise ValueError(f"{order} is {kind.simpleString()}, neither a number nor a timestamp")


def _cut(df: DataFrame, order: tuple[str, ...], chunk: int | Column) -> tuple[DataFrame, str]:
    """``df`` with the chunk of each row (a width of the first order column, or a number that grows with the order), and a prefix that none of its columns has."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    at = chunk if isinstance(chunk, Column) else F.floor(position(df, order[0]) / chunk)
    return df.withColumn(f"{p}chunk", F.coalesce(at, F.lit(-(2**62)))), p


def _carry(cut: DataFrame, tops: DataFrame, keys: tuple[str, ...], carried: dict[str, Column], p: str) -> DataFrame:
    """``cut`` with the columns ``carried``, computed over the chunks before each row's own."""
    before = tops.select(*[F.col(k).alias(f"{p}k_{k}") for k in keys], F.col(f"{p}chunk").alias(f"{p}of"), *[c.alias(n) for n, c in carried.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{p}k_{k}")) for k in keys], F.col(f"{p}chunk") == F.col(f"{p}of"))
    return cut.join(before, same, "left").drop(f"{p}of", *[f"{p}k_{k}" for k in keys])


def _earlier(keys: tuple[str, ...], p: str):
    return Window.partitionBy(*keys).orderBy(f"{p}chunk").rowsBetween(Window.unboundedPreceding, -1)


def running_max(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: dict[str, Column], inclusive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Running maxima of ``values`` (name: column), over the rows before or (``inclusive``) up to each row."""
    cut, p = _cut(df, order, chunk)
    cut = cut.withColumns({f"{p}v_{n}": v for n, v in values.items()})
    tops = cut.groupBy(*keys, f"{p}chunk").agg(*[F.max(f"{p}v_{n}").alias(n) for n in values])
    told = _carry(cut, tops, keys, {f"{p}c_{n}": F.max(n).over(_earlier(keys, p)) for n in values}, p)
    inside = Window.partitionBy(*keys, f"{p}chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = told.withColumns({n: F.greatest(f"{p}c_{n}", F.max(f"{p}v_{n}").over(inside)) for n in values})
    return out.drop(f"{p}chunk", *[f"{p}{k}_{n}" for n in values for k in "vc"])


def running_sum(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """The sum of ``value`` up to each row; nulls add nothing."""
    cut, p = _cut(df, order, chunk)
    cut = cut.withColumn(f"{p}v", F.coalesce(value, F.lit(0)))
    tops = cut.groupBy(*keys, f"{p}chunk").agg(F.sum(f"{p}v").alias(f"{p}s"))
    told = _carry(cut, tops, keys, {f"{p}c": F.sum(f"{p}s").over(_earlier(keys, p))}, p)
    inside = Window.partitionBy(*keys, f"{p}chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told.withColumn(name, F.coalesce(f"{p}c", F.lit(0)) + F.sum(f"{p}v").over(inside)).drop(f"{p}chunk", f"{p}v", f"{p}c")


def previous(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """``value`` of the row before; null for the first row of a key."""
    cut, p = _cut(df, order, chunk)
    tops = cut.groupBy(*keys, f"{p}chunk").agg(F.max_by(F.struct(value), F.struct(*order)).alias(f"{p}last"))
    told = _carry(cut, tops, keys, {f"{p}c": F.last(f"{p}last").over(_earlier(keys, p))}, p)
    inside = F.lag(F.struct(value)).over(Window.partitionBy(*keys, f"{p}chunk").orderBy(*order))
    return told.withColumn(f"{p}p", F.coalesce(inside, f"{p}c")).withColumn(name, F.col(f"{p}p").getField(value)).drop(f"{p}chunk", f"{p}c", f"{p}p")


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str, chunk: int | Column = CHUNK) -> DataFrame:
    """The 1-based row number of each row among its key's rows in ``order``.

    Ties beyond ``order`` are numbered in any order.
    """
    cut, p = _cut(df, order, chunk)
    tops = cut.groupBy(*keys, f"{p}chunk").agg(F.count("*").alias(f"{p}n"))
    told = _carry(cut, tops, keys, {f"{p}c": F.sum(f"{p}n").over(_earlier(keys, p))}, p)
    inside = F.row_number().over(Window.partitionBy(*keys, f"{p}chunk").orderBy(*order))
    return told.withColumn(name, (F.coalesce(f"{p}c", F.lit(0)) + inside).cast("long")).drop(f"{p}chunk", f"{p}c")
