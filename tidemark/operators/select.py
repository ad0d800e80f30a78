"""Projections, filters, limits and positional access."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators import running

SPLIT = 16
WITHIN = 64  # chunks of one value at most
ORDER = ("timestamp", "event_id")


def by_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.col("symbol") == symbol)


def by_exchanges(df: DataFrame, exchanges: list[str]) -> DataFrame:
    """Rows of the chosen exchanges, whatever their case; an empty list filters nothing."""
    return df.where(F.upper("exchange").isin([e.upper() for e in exchanges])) if exchanges else df


def last_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last |n| rows in ``order``, ascending: a top-n per partition, then one merge."""
    order = order or ORDER
    return df.orderBy(*[F.desc(c) for c in order]).limit(abs(n)).orderBy(*order)


def newest_first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order or ORDER])


def live_view(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows with latency_seconds against ``now`` (default: the current time)."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return df.withColumn("latency_seconds", S.latency_seconds(F.col("timestamp"), now))


def _steps(at: Column, bounds: list, first: int = 0) -> Column:
    """``first`` and up: how many of the sorted ``bounds`` lie below ``at``, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(at <= F.lit(bounds[half]), _steps(at, bounds[:half], first)).otherwise(_steps(at, bounds[half + 1 :], first + half + 1))


def numbered(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """A global 1-based row number in ``order`` without a one-partition window over the rows.

    The rows are cut into about ``SPLIT`` chunks for each shuffle partition at quantiles of
    the first order column, so outliers do not gather the rest in one task; a value that
    fills several chunks is cut again by quantiles of the second column, where that is a
    number or a time. Rows are numbered inside each chunk and shifted by the counts of the
    chunks before. The cuts are fixed before, so counting and numbering see the same
    chunks. For many pages of one table store its order once (``operators.pages``).
    """
    order = order or ORDER
    parts = SPLIT * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = running.position(df, order[0]).cast("double")
    cuts = df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    bounds = sorted(set(cuts))
    where, part = S.free(df, "position", "part")
    placed = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=where, outputCol=part, handleInvalid="keep").transform(df.withColumn(where, at)) if bounds else df.withColumns({where: at, part: F.lit(0.0)})
    inside = F.lit(0)
    heavy = [v for v in bounds if cuts.count(v) > 1]
    if heavy and len(order) > 1 and isinstance(df.schema[order[1]].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType)):
        then = running.position(df, order[1]).cast("double")
        shares = {v: [i / n for i in range(1, n)] for v in heavy for n in [min(WITHIN, cuts.count(v) + 1)]}
        found = df.agg(*[F.percentile_approx(F.when(at == v, then), shares[v], 10 * WITHIN).alias(f"q{i}") for i, v in enumerate(heavy)]).first()
        for i, v in enumerate(heavy):  # its chunk begins with it
            own = F.coalesce(_steps(then, sorted(set(found[f"q{i}"] or []))), F.lit(0))
            inside = F.when(F.col(where) == v, own).when(F.col(part) == bounds.index(v) + 1, WITHIN).otherwise(inside)
    chunk = F.when(F.col(where).isNotNull(), F.col(part).cast("long") * (WITHIN + 1) + inside)
    return running.numbered(placed, (), order, name, chunk).drop(where, part)


def positions(df: DataFrame, offset: int, max_rows: int, *order: str) -> DataFrame:
    """Rows [offset, offset + max_rows) in ``order``; for a page near either end of a table."""
    return df.orderBy(*(order or ORDER)).offset(offset).limit(max_rows)


def book_columns(books: DataFrame) -> DataFrame:
    """bid_prices, bid_sizes, ask_prices, ask_sizes from the two rows of each side."""
    return books.select(
        *[c for c in books.columns if c not in ("bids", "asks")],
        S.row_of(F.col("bids"), 1).alias("bid_prices"), S.row_of(F.col("bids"), 2).alias("bid_sizes"),
        S.row_of(F.col("asks"), 1).alias("ask_prices"), S.row_of(F.col("asks"), 2).alias("ask_sizes"))


def best_quotes(books: DataFrame) -> DataFrame:
    return books.select(
        *[c for c in books.columns if c not in ("bids", "asks")],
        S.first_of(F.col("bids"), 1).alias("best_bid"), S.first_of(F.col("bids"), 2).alias("best_bid_size"),
        S.first_of(F.col("asks"), 1).alias("best_ask"), S.first_of(F.col("asks"), 2).alias("best_ask_size"))


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to the declared types; a value that cannot be cast becomes null, unknown columns go."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])


def public(df: DataFrame) -> DataFrame:
    return df.drop("_rowid")
