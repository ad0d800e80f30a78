"""Time sampling and latest rows. All work on batch and, where noted, on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S


def _tie(df: DataFrame) -> str:
    return "event_id" if "event_id" in df.columns else "trade_id"


def candles(trades: DataFrame, every: str = "5s") -> DataFrame:
    """Open, low, high, close, VWAP and volumes for each bucket and symbol, across exchanges.

    Open and close are the prices at the least and greatest (timestamp, tie-breaker).
    Volumes are summed in whole millionths, so the result does not depend on the
    order of rows. One partial aggregate before the shuffle; also valid on a
    watermarked stream.
    """
    order = F.struct("timestamp", _tie(trades))
    base, quote = F.sum(S.millionths(F.col("size"))), F.sum(S.millionths(F.col("price") * F.col("size")))
    out = trades.groupBy(F.window("timestamp", S.duration(every)).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("openp"), F.min("price").alias("lowp"), F.max("price").alias("highp"), F.max_by("price", order).alias("closep"),
        F.round(F.try_divide(quote, F.nullif(base, F.lit(0))), 4).alias("vwap"), (base / 1e6).alias("volume_base"), (quote / 1e6).alias("volume_quote"))
    return out.select(F.col("w.start").alias("ts"), "symbol", "openp", "lowp", "highp", "closep", "vwap", "volume_base", "volume_quote")


def sample_books(books: DataFrame, every: str = "1s") -> DataFrame:
    """The last snapshot of each bucket, exchange and symbol."""
    order = F.struct("timestamp", _tie(books))
    return books.groupBy(F.window("timestamp", S.duration(every)).alias("w"), "exchange", "symbol").agg(
        F.max_by("bids", order).alias("bids"), F.max_by("asks", order).alias("asks")).select(F.col("w.start").alias("timestamp"), "exchange", "symbol", "bids", "asks")


def latest(df: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """The newest row of each key: one aggregate with map-side combine, no sort."""
    order = F.struct("timestamp", _tie(df)) if order is None else order
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
