"""Market-data tables derived from the driver's ``events`` table, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar as S

START = 1704067200000000
#: The same tables as DuckDB common table expressions.
TRADES_SQL = """
trades AS (SELECT make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000) AS timestamp,
  ['COINBASE','BITSTAMP','KRAKEN'][(user_id % 3) + 1] AS exchange,
  ['BTC-USD','ETH-USD','AVAX-USD','SOL-USD'][(user_id % 4) + 1] AS symbol,
  value AS price, cast(props::json->>'$.k' AS DOUBLE) / 100 AS size,
  CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, cast(event_id AS VARCHAR) AS trade_id, event_id FROM events)"""
BOOKS_SQL = TRADES_SQL + """,
levels AS (SELECT t.*, i, price - price * 0.0001::DOUBLE * i AS bid, price + price * 0.0001::DOUBLE * i AS ask,
  cast((event_id * 31 + i * 17) % 190 + 10 AS DOUBLE) / 100::DOUBLE AS volume FROM trades t, range(1, 21) r(i))"""
L2_SQL = TRADES_SQL + """,
changes AS (SELECT timestamp, event_id, exchange, symbol, CASE WHEN side = 'buy' THEN 'bid' ELSE 'ask' END AS side,
  floor(price) AS price, CASE WHEN size < 0.2 THEN 0 ELSE size END AS amount FROM trades)"""
L3_SQL = TRADES_SQL + """,
orders AS (SELECT event_id AS sequence, (event_id * 7919) % 1500 AS order_id,
  ['open','match','change','match','done','match','open'][(event_id % 7) + 1] AS type,
  CASE WHEN event_id % 7 = 4 AND ((event_id * 7919) % 1500) % 10 = 0 THEN NULL ELSE ((event_id * 7919) % 1500) % 50 + 100 END AS price,
  cast(round(size * 100) AS BIGINT) AS size FROM trades)"""
SEQ_SQL = TRADES_SQL + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_id) AS n FROM trades),
feed AS (SELECT symbol, event_id, CASE WHEN n % 50 = 7 THEN n - 1 ELSE n END AS seq FROM numbered WHERE n % 100 <> 31)"""
LEDGER_SQL = TRADES_SQL + """,
ledger AS (SELECT event_id // 100 AS txn_id, CASE WHEN (event_id // 100) % 7 = 0 THEN NULL ELSE count(*) END AS row_count,
  min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM trades GROUP BY event_id // 100)"""


def _pick(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)


def trades_from(events: DataFrame) -> DataFrame:
    """Trades with event_id as numeric tie-breaker; works on batch and streaming events."""
    micros = F.lit(START) + F.floor((S.epoch_micros(F.col("ts")) - START) / 1000).cast("long")
    return events.select(
        S.from_micros(micros).alias("timestamp"), _pick(schemas.EXCHANGES, F.col("user_id") % 3).alias("exchange"), _pick(schemas.SYMBOLS, F.col("user_id") % 4).alias("symbol"),
        F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("size"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("event_id").cast("string").alias("trade_id"), "event_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from(events(spark, sf_dir))


def books_from(trades: DataFrame) -> DataFrame:
    """One 20-level snapshot for each trade; works on batch and streaming trades."""
    i = F.sequence(F.lit(1), F.lit(20))
    volumes = F.transform(i, lambda x: ((F.col("event_id") * 31 + x * 17) % 190 + 10).cast("double") / 100.0)
    side = lambda sign: F.transform(i, lambda x: F.col("price") + F.col("price") * F.lit(0.0001) * x if sign > 0 else F.col("price") - F.col("price") * F.lit(0.0001) * x)
    return trades.select("timestamp", "exchange", "symbol", F.array(side(-1), volumes).alias("bids"), F.array(side(1), volumes).alias("asks"), "event_id")


def orderbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books_from(trades(spark, sf_dir))


def l2_from(trades: DataFrame) -> DataFrame:
    return trades.select(
        "timestamp", "event_id", "exchange", "symbol", F.when(F.col("side") == "buy", "bid").otherwise("ask").alias("side"),
        F.floor("price").cast("double").alias("price"), F.when(F.col("size") < 0.2, 0.0).otherwise(F.col("size")).alias("amount"))


def l2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l2_from(trades(spark, sf_dir))


def l3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (F.col("event_id") * 7919) % 1500
    market = (F.col("event_id") % 7 == 4) & (order % 10 == 0)
    return trades(spark, sf_dir).select(
        F.col("event_id").alias("sequence"), order.alias("order_id"), _pick(("open", "match", "change", "match", "done", "match", "open"), F.col("event_id") % 7).alias("type"),
        F.when(~market, order % 50 + 100).alias("price"), F.round(F.col("size") * 100).cast("long").alias("size"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, event_id (arrival), seq: one sequence per symbol with repeats and holes."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("symbol").orderBy("event_id"))
    return trades(spark, sf_dir).withColumn("n", n).where("n % 100 <> 31").select("symbol", "event_id", F.when(F.col("n") % 50 == 7, F.col("n") - 1).otherwise(F.col("n")).cast("long").alias("seq"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = F.floor(F.col("event_id") / 100)
    return trades(spark, sf_dir).groupBy(txn.cast("long").alias("txn_id")).agg(
        F.count("*").alias("row_count"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")).withColumn(
        "row_count", F.when(F.col("txn_id") % 7 != 0, F.col("row_count")))


KINDS = ("match",) * 10 + ("ticker",) * 2 + ("l2update",) * 2 + ("snapshot", "received", "open", "done", "change", "other")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(trades(spark, sf_dir))


def messages_from(t: DataFrame) -> DataFrame:
    """raw (JSON text), receipt (arrival number): one exchange message for each trade."""
    kind = _pick(KINDS, F.col("event_id") % 20)
    kind = F.when(kind == "other", F.when(F.col("event_id") % 40 == 19, "subscriptions").otherwise("mystery")).otherwise(kind)
    text = lambda c: c.cast("string")
    price, size, eid = F.col("price"), F.col("size"), F.col("event_id")
    level = lambda p, s: F.array(text(p), text(s))
    side = F.when(eid % 2 == 0, "buy").otherwise("sell")
    snap = F.when(kind == "snapshot", F.array(*[level(F.floor(price) - i, F.lit(i) / 2) for i in (1, 2, 3)]))
    snap_asks = F.when(kind == "snapshot", F.array(*[level(F.floor(price) + i, F.lit(i) / 4) for i in (1, 2)]))
    changes = F.when(kind == "l2update", F.array(F.array(side, text(F.floor(price)), text(size)), F.array(F.lit("sell"), text(F.floor(price) + 1), F.lit("0"))))
    body = F.struct(
        kind.alias("type"), eid.alias("sequence"), F.col("symbol").alias("product_id"), text(price).alias("price"), text(size).alias("size"), side.alias("side"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), eid.alias("trade_id"),
        text((eid * 7) % 1500).alias("maker_order_id"), text((eid * 11) % 300).alias("taker_order_id"),
        F.when(kind.isin("received", "open", "done", "change"), text(eid % 300)).alias("order_id"),
        F.when(kind == "received", F.when(eid % 3 == 0, "market").otherwise("limit")).alias("order_type"),
        text(price - 0.5).alias("best_bid"), text(price + 0.5).alias("best_ask"), snap.alias("bids"), snap_asks.alias("asks"), changes.alias("changes"))
    return t.select(F.to_json(body).alias("raw"), eid.alias("receipt"))
