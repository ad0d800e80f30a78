"""Counts, summaries and chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import select


def trade_summary(trades: DataFrame, *keys: str) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.round(F.sum(S.millionths(F.col("price"))) / F.count("price") / 1e6, 4).alias("avg_price"), (F.sum(S.millionths(F.col("size"))) / 1e6).alias("total_size"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def time_extent(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("rows"))


def chart_points(trades: DataFrame, exchanges: list[str]) -> DataFrame:
    """exchange, time (epoch seconds), value of the chosen exchanges; unreadable rows are left out."""
    return select.by_exchanges(trades, exchanges).select(
        F.upper("exchange").alias("exchange"), S.epoch_seconds(F.col("timestamp")).alias("time"), S.number(F.col("price")).alias("value")).where("time is not null and value is not null")


def chart_series(trades: DataFrame, exchanges: list[str]) -> DataFrame:
    """exchange, series: points sorted by time. Give it a bounded frame (``select.last_rows``)."""
    return chart_points(trades, exchanges).groupBy("exchange").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("series"))


def series_chunks(trades: DataFrame, exchanges: list[str], seconds: int = 60) -> DataFrame:
    """exchange, chunk, series: like ``chart_series``, one row for each ``seconds`` of an exchange, so whole tables do."""
    chunk = F.floor(F.col("time") / seconds).alias("chunk")
    return chart_points(trades, exchanges).groupBy("exchange", chunk).agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("series"))


def chart_stats(trades: DataFrame, exchanges: list[str]) -> DataFrame:
    """Points for each chosen exchange, 0 where it has none, beside the total and the exchanges with data."""
    chosen = F.explode(F.array(*[F.lit(e.upper()) for e in exchanges])).alias("exchange")
    asked = trades.sparkSession.range(1).select(chosen)
    n = chart_points(trades, exchanges).groupBy("exchange").agg(F.count("*").alias("points"))
    each = asked.join(n, "exchange", "left").select("exchange", F.coalesce("points", F.lit(0)).cast("long").alias("points"))
    whole = each.agg(F.collect_list(F.struct("exchange", "points")).alias("e"), F.sum("points").alias("total_points"), F.sum(F.when(F.col("points") > 0, 1).otherwise(0)).cast("long").alias("with_data"))
    return whole.select(F.explode("e").alias("x"), "total_points", "with_data").select("x.exchange", "x.points", "total_points", "with_data")


def series_json(series: DataFrame) -> DataFrame:
    return series.select(*[c for c in series.columns if c != "series"], F.to_json("series").alias("json"))
